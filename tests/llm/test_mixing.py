import random
from collections import defaultdict

import pytest

from loomway.llm.mixing import blocks_before, mix, period_slots, pfair, quotas, schedule, shares

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("gone", 0.05, 3)]


def frames(spark, docs, targets=TARGETS):
    return spark.createDataFrame(docs, "doc_id long, source string, tokens long").selectExpr("*", "1 as slot", "'x' as text"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def documents(n=4000):
    r = random.Random(4)
    rows = [(i, r.choices(["a", "b", "c", None, "other"], [6, 1, 1, 1, 1])[0], r.choice([0, 5, 50, 400])) for i in range(n)]
    return rows + [(n, "a", None)]


def test_a_period_meets_all_deadlines():
    r = random.Random(1)
    for _ in range(60):
        counts = tuple(r.choice([1, 2, 5, 40, 200]) for _ in range(r.randrange(1, 9)))
        source, number = pfair(counts)
        done = [0] * len(counts)
        for slot, (i, k) in enumerate(zip(source, number), 1):
            assert k == done[i]
            done[i] += 1
            assert all(abs(c * slot / sum(counts) - d) < 1 for c, d in zip(counts, done))
        assert tuple(done) == counts


def test_periods_never_lack_a_block():
    for weights in ([0.5, 0.3, 0.2], [1 / 3, 1 / 3, 1 / 3], [0.97, 0.02, 0.001, 0.009], [1.0]):
        size = period_slots(weights)
        for p in (0, 1, 7, 10**6):
            a, z = blocks_before(weights, p * size), blocks_before(weights, (p + 1) * size)
            assert sum(a) == p * size and sum(z) == (p + 1) * size
            assert all(y > x for x, y in zip(a, z))
            assert all(abs(w * p * size - x) < 1 for w, x in zip(weights, a))


def test_deviation_is_under_one_fixed_block_at_any_size(spark):
    unit = 50
    for times in (1, 30):
        q = quotas({"a": 10_000 * times, "b": 900 * times, "c": 4_000 * times}, TARGETS)
        frame, slots = schedule(spark, q, unit)
        order = sorted((r.slot, r.source, r.block) for r in frame.collect())
        weight, tokens = {x.source: x.weight for x in q}, {x.source: x.tokens for x in q}
        done = defaultdict(int)
        for slot, source, k in order:
            assert k == done[source]
            done[source] += 1
            for s, w in weight.items():
                if w and done[s] * unit < tokens[s]:
                    assert abs(w * (slot + 1) - done[s]) < 2  # half blocks
        assert len(order) <= slots and len({s for s, *_ in order}) == len(order)
        assert all(done[s] * unit >= t > (done[s] - 1) * unit for s, t in tokens.items() if t)
        assert abs(sum(weight.values()) - 1) < 1e-9 and weight["gone"] == 0


def test_quotas_keep_repeat_limits():
    q = {x.source: x for x in quotas({"a": 10_000, "b": 900, "c": 4_000}, TARGETS)}
    total = sum(x.tokens for x in q.values())
    for x in q.values():
        assert x.tokens <= x.available * x.max_repeats + 1e-6
        assert abs(x.tokens / total - x.weight) < 1e-12
    assert quotas({}, TARGETS)[0].tokens == 0


@pytest.mark.parametrize("broadcast", [1 << 17, 0])
def test_mix(spark, monkeypatch, broadcast):
    from loomway.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", broadcast)
    docs = documents()
    sizes, targets = frames(spark, docs)
    rows = mix(sizes, targets, block_tokens=400).collect()
    tokens = {i: t or 0 for i, _, t in docs}
    uses = defaultdict(int)
    for r in rows:
        uses[r.doc_id] += 1
        assert r.tokens == tokens[r.doc_id]
    limit = {s: m for s, _, m in TARGETS}
    source = {i: s for i, s, _ in docs}
    assert all(n <= limit[source[i]] for i, n in uses.items())
    ordered = sorted(rows, key=lambda r: (r.slot, r.source, r.start, r.tokens))
    at = defaultdict(int)
    for r in ordered:  # positions in each source's stream follow each other without a gap
        assert r.start == at[r.source]
        at[r.source] += r.tokens
    got = {r.source: r for r in shares(mix(sizes, targets, block_tokens=400), sizes, targets).collect()}
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    scale = 0.95
    for s, w, m in TARGETS[:3]:
        assert abs(got[s].actual_share - w / scale) < 0.005 and got[s].most_uses <= m
    assert (got["gone"].documents, got["gone"].mixed_tokens, got["gone"].actual_share) == (0, 0, 0.0)


def test_empty_and_repeated(spark):
    sizes, targets = frames(spark, [(1, None, 5), (2, "zz", 5)])
    assert mix(sizes, targets).count() == 0
    sizes, targets = frames(spark, [], [])
    assert mix(sizes, targets).count() == 0 and shares(mix(sizes, targets), sizes, targets).count() == 0
    sizes, targets = frames(spark, [(1, "a", 10), (2, "a", 0), (3, "b", 10)], [("a", 0.5, 1), ("b", 0.5, 1), (None, 0.1, 1)])
    assert sorted(r.doc_id for r in mix(sizes, targets).collect()) in ([1, 2, 3], [1, 3])
