"""Text keys for line references and names."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomway.functions.exprs import let

# Words before a line's reference, letters before it, signs behind such a letter, and the words that make an express bus.
LINE_WORDS = ("ligne", "line")
LINE_LETTERS = ("t", "m", "l")
LETTER_SIGNS = ("-", ".", ":")
EXPRESS_WORDS = ("express", "bhns", "liane", "chronobus")


def _plain(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str]:
    """Characters that fold to one, what they fold to, and a JSON map of those that fold to several; by the rule, not by a list."""
    first, last = 0x80, 0x20000  # beyond it there are only ideographs
    folds = {c: f for c in map(chr, range(first, last)) if unicodedata.decomposition(c) and (f := _plain(c))}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), json.dumps({c: f for c, f in folds.items() if c not in one})


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII, inside the JVM; null gives an empty text.

    One translation does for most characters; only texts that still have other
    ones are looked up one by one. What folds to nothing is dropped.
    """
    source, target, rest = _folds()
    t = F.translate(F.coalesce(c, F.lit("")), source, target)
    table = F.from_json(F.lit(rest), "map<string,string>")
    one = lambda x: F.coalesce(F.try_element_at(table, x), F.when(x.rlike(r"\A[\x00-\x7f]*\z"), x), F.lit(""))
    several = lambda x: F.array_join(F.transform(F.split(x, ""), one), "")
    return let(t, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), several(x)).otherwise(x))


def _only_letters(t: Column) -> Column:
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def normalise_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits only; empty for null."""
    return _only_letters(F.lower(ascii_fold(c)))


def normalise_ref(c: Column) -> Column:
    """A line's reference without a leading word for line, nor a leading letter with its sign before another letter or digit."""
    left = lambda t: F.regexp_replace(t, r"\A\s+", "")
    after = lambda t, n: left(F.substr(t, F.lit(n + 1)))
    no_word = lambda t: F.coalesce(*(F.when(F.startswith(t, F.lit(w)), after(t, len(w))) for w in LINE_WORDS), t)
    no_sign = lambda r: F.when(F.substring(r, 1, 1).isin(*LETTER_SIGNS), after(r, 1)).otherwise(r)
    no_letter = lambda t: let(let(after(t, 1), no_sign), lambda r: F.when(F.substring(t, 1, 1).isin(*LINE_LETTERS) & r.rlike(r"\A[a-z0-9]"), r).otherwise(t))
    return _only_letters(let(let(left(F.lower(ascii_fold(c))), no_word), no_letter))


def is_express_bus(*names: Column) -> Column:
    return let(normalise_text(F.concat_ws(" ", *names)), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in EXPRESS_WORDS)))
