"""Codes of the older survey as those of the newer one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomway.functions.exprs import code_map
from loomway.functions.modes import NO_ANSWER, RESIDENCE

# Modes of transport of the older survey, by the newer one's code.
MODE_CODES = {
    1.1: ("1.10", "1.11", "1.12", "1.13"), 2.1: ("2.20",), 2.3: ("2.22", "2.23", "2.24", "2.25", "2.29"), 3.1: ("3.30", "3.31"), 3.2: ("3.32",), 3.3: ("3.33",), 3.4: ("3.39",),
    4.1: ("4.40", "4.41", "4.42", "4.43"), 5.1: ("5.50", "5.59"), 5.2: ("5.51",), 5.3: ("5.52",), 5.4: ("5.53",), 5.5: ("5.54",), 5.6: ("5.55",), 5.7: ("5.56",), 5.8: ("5.57",), 5.9: ("5.58",),
    6.1: ("6.60", "6.61"), 6.3: ("6.62", "6.63", "6.69"), 7.1: ("7.70",), 8.1: ("8.80",), 9.1: ("9.90",),
}
# Purposes of the older survey, by the newer one's code.
PURPOSE_CODES = {
    1.1: ("1.1",), 1.2: ("1.2",), 1.3: ("1.3",), 1.4: ("1.11",), 1.5: ("1.12",), 2.1: ("2.20",), 2.2: ("2.21",), 3.1: ("3.31",), 4.1: ("4.41",), 5.1: ("5.51",), 5.2: ("5.52",),
    6.1: ("6.61",), 6.2: ("6.62",), 6.3: ("6.63",), 6.4: ("6.64",), 7.1: ("7.71",), 7.2: ("7.72",), 7.3: ("7.73",), 7.4: ("7.74",), 7.5: ("7.75",), 7.6: ("7.76",), 7.7: ("7.77",), 7.8: ("7.78",),
    8.1: ("8.80",), 8.2: ("8.81",), 8.3: ("8.82",), 8.4: ("8.89",), 9.1: ("9.91",), 9.2: ("9.92",), 9.3: ("9.94",), 9.4: ("9.95",), 9.5: ("9.96",),
}
LOOP = 7.7


def by_old_code(table: dict[float, tuple[str, ...]]) -> dict[str, float]:
    return {old: new for new, olds in table.items() for old in olds}


def new_mode(code: Column) -> Column:
    """The newer survey's mode; null for a code without one."""
    return code_map(code, by_old_code(MODE_CODES))


def new_purpose(code: Column) -> Column:
    """The newer survey's purpose; null for a code without one."""
    return code_map(code, by_old_code(PURPOSE_CODES))


def motive(destination: Column, before: Column) -> Column:
    """A trip's motive: that of its destination, and for a way home the purpose it comes from; no answer is null."""
    known = lambda c: F.nullif(c, F.lit(float(NO_ANSWER)))
    return F.when(destination.isin(*map(float, RESIDENCE)), known(before)).otherwise(known(destination))
