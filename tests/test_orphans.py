import random
from datetime import datetime, timedelta

from loomway.operators.orphans import orphan_report, orphans

T0 = datetime(2024, 1, 1)
CHILD = "rec_id long, key string, loaded_at timestamp_ntz, h string"
PARENT = "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, h2 string"


def brute(children, parents):
    norm = lambda k: k.strip().lower() if k and k.strip() else None
    out = []
    for rec, key, t, _ in children:
        k = norm(key)
        if k is None:
            continue
        same = [(s, e) for pk, s, e, _ in parents if norm(pk) == k]
        loaded = [(s, e) for s, e in same if s is not None and t is not None and s <= t]
        if any(e is None or e > t for _, e in loaded):
            continue
        out.append(("c", None if t is None else t.strftime("%Y-%m"), rec, "missing" if not same else "deleted" if loaded else "late"))
    return sorted(out, key=repr)


def run(spark, children, parents, **kw):
    df = orphans(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), "key", "key", "c", **kw)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nulls_spelling_and_reasons(spark):
    day = lambda n: T0 + timedelta(days=n)
    parents = [("A ", day(1), None, "x"), ("b", day(5), None, "x"), ("C", day(0), day(3), "x"), ("C", day(8), None, "x"), (None, day(0), None, "x"), ("n", None, None, "x"), ("  ", day(0), None, "x")]
    children = [(1, "a", day(2), "y"), (2, " B\t", day(2), "y"), (3, "c", day(4), "y"), (4, "zz", day(4), "y"), (5, None, day(4), "y"), (6, "  ", day(4), "y"), (7, "c", day(3), "y"), (8, "c", day(8), "y"), (9, "n", day(8), "y"), (10, "a", None, "y"), (None, "zz", day(1), "y"), (4, "zz", day(4), "y")]
    got = run(spark, children, parents)
    assert got == brute(children, parents)
    assert {r[2]: r[3] for r in got} == {2: "late", 3: "deleted", 4: "missing", 7: "deleted", 9: "late", 10: "late", None: "missing"}


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", T0, "y")], []) == [("c", "2024-01", 1, "missing")]
    assert run(spark, [], [("a", T0, None, "x")]) == []


def test_hot_keys_over_many_ranges_and_splits(spark):
    r = random.Random(3)
    at = lambda: T0 + timedelta(hours=r.randrange(900))
    key = lambda: "hot" if r.random() < 0.4 else f"k{r.randrange(40)}"
    parents = []
    for _ in range(500):
        s = at()
        parents.append((key(), s, s + timedelta(hours=r.randrange(1, 30)) if r.random() < 0.8 else None, "x"))
    parents = [(k, s, e or (None if k != "hot" else s + timedelta(hours=2)), h) for k, s, e, h in parents]
    children = [(i, key() if r.random() < 0.9 else f"no{i}", at(), "y") for i in range(1500)]
    got = run(spark, children, parents, rows_per_range=20, rows_per_split=50)
    assert got == brute(children, parents)
    assert {x[3] for x in got} == {"missing", "deleted", "late"}


def test_report(spark):
    df = orphans(spark.createDataFrame([(i, "q", T0, "y") for i in range(5)], CHILD), spark.createDataFrame([], PARENT), "key", "key", "c")
    assert [tuple(r) for r in orphan_report(df).collect()] == [("c", "2024-01", "missing", 5)]
