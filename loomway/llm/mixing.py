"""Mixing of sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a block, at any size of the mix: in every prefix of the slots each source is less than this from its share.
BLOCK_TOKENS = 4096
#: Slots of a period at least, slots of a task of the schedule, and slots up to which the schedule is broadcast.
PERIOD_SLOTS, TASK_SLOTS, BROADCAST_SLOTS = 256, 1 << 20, 1 << 17
#: Documents of a source per bucket of its order.
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Quota:
    source: str
    target: float
    weight: float
    available: int
    max_repeats: int
    tokens: float


def quotas(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> list[Quota]:
    """How many tokens each source gives, for the largest mix that keeps all shares and repeat limits.

    A source without tokens, weight or allowed uses gives nothing, and the
    other targets are scaled up to 1. `weight` is the scaled target.
    """
    usable = {s for s, w, m in targets if w and w > 0 and m and m > 0 and totals.get(s, 0) > 0}
    scale = math.fsum(w for s, w, _ in targets if s in usable)
    total = min((totals[s] * m * scale / w for s, w, m in targets if s in usable), default=0.0)
    return [Quota(s, float(w or 0), w / scale if s in usable else 0.0, totals.get(s, 0), int(m or 0), total * w / scale if s in usable else 0.0) for s, w, m in targets]


@lru_cache(maxsize=4096)
def pfair(counts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(source, block number) of each slot of a period that has counts[i] blocks of source i.

    With D slots, block k of a source with c blocks is released at floor(kD / c)
    and due at ceil((k + 1)D / c). In each slot the released block with the
    earliest deadline goes (the source's place in the list at ties). As the
    counts fill the period, each block meets its deadline, so at every slot each
    source is less than one block from its share c / D.
    """
    slots = sum(counts)
    waiting = [(0, i, 0) for i, c in enumerate(counts) if c]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    source, number = np.empty(slots, np.int32), np.empty(slots, np.int64)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // counts[i]), i, k))
        _, i, k = heapq.heappop(ready)
        source[slot], number[slot] = i, k
        if k + 1 < counts[i]:
            heapq.heappush(waiting, ((k + 1) * slots // counts[i], i, k + 1))
    return source, number


def blocks_before(weights: Sequence[float], slot: int) -> list[int]:
    """Blocks of each source in the slots before `slot`, a multiple of the period: less than one from the weight's share, and `slot` together."""
    ends, upto = [], 0.0
    for w in weights[:-1]:
        upto += w
        ends.append(min(slot, math.floor(upto * slot + 0.5)))
    ends = [0, *ends, slot]
    return [z - a for a, z in zip(ends, ends[1:])]


def period_slots(weights: Sequence[float]) -> int:
    """So many that every source has a block in each period, whatever the rounding at its ends."""
    return max(PERIOD_SLOTS, math.ceil(2 / min(weights, default=1.0)))


def schedule(spark: SparkSession, mix: Sequence[Quota], unit: int) -> tuple[DataFrame, int]:
    """(source, block, slot) of all blocks of `unit` tokens, and the number of slots.

    The axis is cut into periods. What each source has before a period follows
    from its weight alone, so every task can compute its periods by itself; the
    period's slots are those of pfair(). Against the straight line a source is
    less than one block off at a period's ends and less than one within, so
    less than two blocks anywhere.
    """
    live = [q for q in mix if q.tokens > 0]
    weights, sources = [q.weight for q in live], np.array([q.source for q in live], object)
    blocks = np.array([math.ceil(q.tokens / unit) for q in live], np.int64)
    size = period_slots(weights)
    periods = max((math.ceil((n + 1) / (w * size)) for n, w in zip(blocks.tolist(), weights)), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["id"]:
                first, last = blocks_before(weights, int(p) * size), blocks_before(weights, (int(p) + 1) * size)
                source, number = pfair(tuple(z - a for a, z in zip(first, last)))
                block = number + np.array(first, np.int64)[source]
                m = block < blocks[source]
                yield pd.DataFrame({"source": sources[source[m]], "block": block[m], "slot": (int(p) * size + np.arange(size))[m]})

    tasks = max(1, math.ceil(periods * size / TASK_SLOTS))
    return spark.range(0, periods, 1, tasks).mapInPandas(run, "source string, block long, slot long"), periods * size


def plan(sizes: DataFrame, targets: DataFrame) -> list[Quota]:
    """Quotas from all documents' sizes (doc_id, source, tokens); the targets are one row per source."""
    totals = {r[0]: int(r[1] or 0) for r in sizes.groupBy("source").agg(F.sum("tokens")).collect()}
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").collect()
    return quotas(totals, [(s, w, m) for s, w, m in rows])


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix, one row per use of a document: (slot, source, start, copy, doc_id, tokens).

    Read in the order (slot, source, start). Each source's documents follow
    each other in an order drawn by hash and begin anew at the end, up to its
    max_repeats; `start` counts the tokens before, and the block in which it
    falls has its slot from schedule(), whose blocks are half of `block_tokens`.
    A source's documents are used until its quota is reached, the last one
    running over by less than its own length.

    Positions come from sums per bucket of the hash order and running sums
    within buckets, so a source that holds most rows spreads over all tasks.
    Documents without a source or without a target don't count. Documents of
    no tokens keep their place. Without usable sources the mix is empty.

    `sizes` is read twice; pass a checkpoint where it is costly.
    """
    spark = sizes.sparkSession
    # One row per source in the targets: their number is the bound of what is collected here.
    named = sizes.select("doc_id", "source", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).join(F.broadcast(targets.select("source").where("source is not null").distinct()), "source", "left_semi")
    q = plan(named, targets)
    live = [x for x in q if x.tokens > 0]
    unit = max(1, block_tokens // 2)
    rows = named.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    h = F.xxhash64(F.lit(seed), "doc_id")
    docs = named.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    offsets = sums.select("source", "bucket", before.alias("offset"))
    params = spark.createDataFrame([(x.source, float(x.tokens), x.available, x.max_repeats) for x in live], "source string, quota double, available long, max_repeats int")
    upto = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = docs.join(offsets, ["source", "bucket"]).withColumn("at", F.col("offset") + upto - F.col("tokens"))
    uses = F.least(F.col("max_repeats"), F.ceil((F.col("quota") - F.col("at")) / F.col("available")))
    copies = (
        placed.join(F.broadcast(params), "source")
        .withColumn("uses", uses.cast("int"))
        .where("uses >= 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
        .withColumn("start", (F.col("copy") - 1) * F.col("available") + F.col("at"))
        .withColumn("block", F.floor(F.col("start") / F.lit(unit)))
    )
    slots, n = schedule(spark, live, unit)
    # A few bytes for each slot; Catalyst can't know how many rows the periods give.
    slots = F.broadcast(slots) if n <= BROADCAST_SLOTS else slots.hint("merge")
    return copies.join(slots, ["source", "block"]).select("slot", "source", "start", "copy", "doc_id", "tokens")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: what it has, what it gives, the share it should have and the one it reached."""
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.count("*").alias("uses"), F.sum("tokens").alias("mixed_tokens"), F.max("copy").alias("most_uses"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = t.join(have, "source", "left").join(got, "source", "left")
    total = F.sum("mixed_tokens").over(W.partitionBy())  # one row per source
    share = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), total), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", zero("documents"), zero("available_tokens"), zero("uses"), zero("mixed_tokens"), zero("most_uses"), share.alias("actual_share"), (share - F.col("target_share")).alias("deviation"))
