"""The README says which queries have no SQL and what is not built."""

from pathlib import Path

import __spark_entry__ as entry

TEXT = (Path(__file__).resolve().parents[1] / "README.md").read_text()


def test_queries_without_sql_are_those_of_three_problems():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert {n[:3] for n in without} <= {"p7_", "p8_", "p9_"}
    assert "No SQL can express `p7_*`, `p8_*` and `p9_*`" in TEXT


def test_named_queries_exist_and_gaps_are_named():
    import re

    names = set(entry.queries())
    quoted = set(re.findall(r"`([xy]_[a-z0-9_]+|t_[a-z_]+|s_[a-z_0-9]+|j_[a-z_]+|k_[a-z_]+)`", TEXT)) - {"k_deploc", "k_individu"}
    assert {q for q in quoted if not q.endswith("_")} <= names
    gaps = TEXT.split("Not built, or in part:", 1)[1]
    assert all(x in gaps for x in ("S16", "K8", "Y21", "D10", "Y25"))
