"""Sentences of a document: what is neither header, signature, standing notice, code nor table."""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import islice

import regex

_TAG = re.compile(r"<(/?)(p|div|br|li|ul|ol|h[1-6]|b|i|em|strong|span|a|td|tr|table)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"<(/?)(p|div|br|li|ul|ol|h[1-6]|td|tr|table)\b[^<>]*>", re.I)
_FENCE = re.compile(r"^\s*(```|~~~)")
#: What may stand before a line's text: comment, quote and list signs, reply marks.
_LEAD = re.compile(r"^(?:[\s#>*•«\"“„+]|-+\s|\d+[.)]\s|(?:re|aw|tr|fwd)\s?:\s)+", re.I)
#: A sentence's end, perhaps with signs, closing quotes or an emoticon behind it.
_END = re.compile(r"[.!?…](?:[^\w]*|\s+[:;=]-?[A-Z])$")
#: Months after which a day number's point ends no sentence (fixed values).
_MONTHS = "januar februar märz maerz marz april mai juni juli august september oktober november dezember"
_SPLIT = re.compile(r"(?<=[.!?…])[»\"”)]*\s+(?!(?<=\d\.\s)(?:" + _MONTHS.replace(" ", "|") + r")\b)(?=[^\s.!?…])", re.I)
#: What is finished of an open piece: signs of a script without blanks may follow an end directly.
_CLOSED = re.compile(r".*[.!?…](?=[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff])")
_WORD = re.compile(r"[^\W_]+")
#: What makes a word more than a number, to the word's end: one match for each such word.
_LETTERED = re.compile(r"[^\W\d_][^\W_]*")
_DIGIT = re.compile(r"\d")
_HIDDEN = regex.compile(r"[\p{Cf}\x00-\x08\x0a-\x1f\x7f-\x9f]+")
#: The common marks, and all of them.
_COMBINING = re.compile("[\u0300-\u036f]+")
_ACCENTS = regex.compile(r"\p{M}+")
_MARKED = re.compile("[ÃÂâ][\u0080-¿€–-™]")


def _redecode(line: str) -> str:
    """A line that was read as Latin-1 or cp1252 although it was UTF-8, put right where that is possible."""
    for codec in ("latin-1", "cp1252"):
        try:
            return line.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return line


def lines_of(text: str) -> list[str]:
    """Lines without code blocks, signatures, markup and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", _BLOCK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    out: list[str] = []
    block: list[str] | None = None
    signed = False
    for line in re.split(r"\r\n|\n|\r", text):
        if _FENCE.match(line):
            block = [] if block is None else None
        elif block is not None:
            block.append(line)
        elif not line.strip():
            signed = False
        elif line.strip() == "--" or line.startswith("-- "):
            signed = True
        elif not signed:
            out.append(line)
    # A block that was never closed is ordinary text.
    return out + (block or [])


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, in order; none for null, empty, blank and number-only texts.

    Of a line that does not end as a sentence does, the open piece behind its
    last end is none: table rows, headings, keys with values, greetings and the
    notices of a network have no other piece. Notices in brackets end as one,
    and are left out by their bracket. One word is no sentence.
    """
    if not text:
        return []
    out = []
    for line in lines_of(text):
        if not line.isascii():
            if _MARKED.search(line):
                line = _redecode(line)
            line = unicodedata.normalize("NFKC", line)
        if not line.isprintable():
            line = _HIDDEN.sub("", line)
        lead = _LEAD.match(line)
        line = (line[lead.end() :] if lead else line).strip()
        if not line or line[0] in "[|":
            continue
        pieces = _SPLIT.split(line)
        if not _END.search(line):
            closed = _CLOSED.match(pieces.pop())
            if closed:
                pieces.append(closed[0])
        out += [s for s in pieces if next(islice(_LETTERED.finditer(s), 1, 2), None)]
    return out


def words(sentence: str) -> list[str]:
    """Lower-case words without accents; a number is one word for all."""
    plain = sentence.lower()
    if not plain.isascii():
        plain = _COMBINING.sub("", unicodedata.normalize("NFKD", plain)).replace("ß", "ss")
        plain = plain if plain.isascii() else _ACCENTS.sub("", plain)
    found = _WORD.findall(plain)
    return ["0" if w.isdigit() else w for w in found] if not plain.isascii() or _DIGIT.search(plain) else found
