"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomway.llm.sentences import sentences, words
from loomway.session import cut

#: Labelled documents that are used for training at most; all documents are scored.
MAX_TRAIN_DOCS = 20_000
#: Training documents of a partition, which gives one gradient a round.
DOCS_PER_PARTITION = 2_500
BUCKETS, DIM = 1 << 16, 16
ROUNDS, RELABEL_FROM = 60, 25
RATE = 0.08
#: A sentence is devoted to its best subject where that reaches this probability.
SURE = 0.35
#: From this probability on a training sentence counts for a subject of its document.
OWN = 0.2
SHARE = 0.2


def features(word: str) -> np.ndarray:
    """Buckets of a word and of its character 3- to 5-grams."""
    w = f"<{word}>"
    grams = {w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))}
    return np.array(sorted(zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int32)


@dataclass
class Model:
    """emb: embedding of each bucket; out, bias: the logistic outputs."""

    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    subjects: tuple[str, ...]

    @classmethod
    def start(cls, subjects: Sequence[str], seed: int = 5) -> Model:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, len(subjects))).astype(np.float32), np.full(len(subjects), -2.0, np.float32), tuple(subjects))

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, self.out, self.bias]


@dataclass
class Batch:
    """Sentences of some documents as word numbers; labels are those of the sentence's document."""

    word_feats: np.ndarray
    word_start: np.ndarray
    occ: np.ndarray
    occ_start: np.ndarray
    labels: np.ndarray
    length: np.ndarray = field(init=False)
    used: np.ndarray = field(init=False)

    def __post_init__(self):
        sizes = np.diff(np.r_[self.word_start, len(self.word_feats)])
        counts = np.diff(np.r_[self.occ_start, len(self.occ)])
        self.length = np.add.reduceat(sizes[self.occ], self.occ_start).astype(np.float32) if len(self.occ) else np.empty(0, np.float32)
        self.used, local = np.unique(self.word_feats, return_inverse=True)
        # Sentences in the order of their words, and words in the order of their buckets: sums then run over neighbours.
        by_word = np.argsort(self.occ, kind="stable")
        self.sent_by_word = np.repeat(np.arange(len(counts)), counts)[by_word]
        self.word_first = np.flatnonzero(np.diff(self.occ[by_word], prepend=-1))
        by_bucket = np.argsort(local, kind="stable")
        self.word_by_bucket = np.repeat(np.arange(len(sizes)), sizes)[by_bucket]
        self.bucket_first = np.flatnonzero(np.diff(local[by_bucket], prepend=-1))

    def payload(self) -> bytes:
        """What of() found, in bytes that Batch.read() takes back."""
        out = io.BytesIO()
        np.savez(out, word_feats=self.word_feats, word_start=self.word_start, occ=self.occ.astype(np.int32), occ_start=self.occ_start, labels=self.labels)
        return out.getvalue()

    @classmethod
    def read(cls, payload: bytes, buckets: np.ndarray) -> Batch:
        """The batch with its buckets as places in `buckets`, which has them all in order."""
        with np.load(io.BytesIO(payload)) as z:
            return cls(np.searchsorted(buckets, z["word_feats"]), z["word_start"], z["occ"].astype(np.int64), z["occ_start"], z["labels"])

    @classmethod
    def of(cls, docs: Iterable[tuple[Sequence[str], np.ndarray]], n: int) -> Batch:
        number: dict[str, int] = {}
        occ, occ_start, labels = [], [], []
        for sents, label in docs:
            for s in sents:
                w = words(s)
                if w:
                    occ_start.append(len(occ))
                    occ += [number.setdefault(x, len(number)) for x in w]
                    labels.append(label)
        feats = [features(w) for w in number]
        start = np.cumsum([0, *map(len, feats)])[:-1]
        return cls(np.concatenate(feats) if feats else np.empty(0, np.int32), start.astype(np.int64), np.array(occ, np.int64), np.array(occ_start, np.int64), np.array(labels, np.float32).reshape(-1, n))


def targets(p: np.ndarray, labels: np.ndarray, relabel: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each sentence should give, and its weight.

    At first a sentence takes its document's subjects. Later it takes the one
    its document names that the model finds likeliest, nothing where the model
    finds none of them likely, and another subject where the model is sure of
    it: a passing mention or a wrong label.
    """
    if not relabel:
        return labels, 1 / np.maximum(1, labels.sum(1))
    y = np.zeros_like(labels)
    own = np.where(labels > 0, p, -1)
    best, top = own.argmax(1), p.argmax(1)
    rows = np.arange(len(p))
    y[rows, best] = own[rows, best] > OWN
    other = (p[rows, top] > 0.6) & (p[rows, top] > own[rows, best] + 0.3)
    y[other] = 0
    y[rows[other], top[other]] = 1
    return y, np.ones(len(p), np.float32)


def gradient(m: Model, b: Batch, relabel: bool) -> tuple[float, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, sentences, touched buckets, and the summed gradients of their embeddings, the outputs and the bias."""
    n = len(b.occ_start)
    if not n:
        return 0.0, 0, np.empty(0, np.int32), np.empty((0, DIM), np.float32), np.zeros_like(m.out), np.zeros_like(m.bias)
    # Outputs are linear in the embeddings: sums over sentences have as many columns as subjects, and embeddings stay with the words.
    word_vec = np.add.reduceat(m.emb[b.word_feats], b.word_start, axis=0)
    z = np.add.reduceat((word_vec @ m.out)[b.occ], b.occ_start, axis=0) / b.length[:, None] + m.bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    y, weight = targets(p, b.labels, relabel)
    loss = float(-(weight[:, None] * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
    g = (p - y) * weight[:, None].astype(np.float32)
    # Every word of a batch occurs in it.
    per_word = np.add.reduceat((g / b.length[:, None])[b.sent_by_word], b.word_first, axis=0)
    dword = per_word @ m.out.T
    return loss, n, b.used, np.add.reduceat(dword[b.word_by_bucket], b.bucket_first, axis=0), word_vec.T @ per_word, g.sum(0)


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, arrays: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(arrays, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def update(m: Model, adam: Adam, parts: list[tuple]) -> float:
    """One synchronous step from the partitions' gradients; gives the mean loss."""
    n = max(1, sum(p[1] for p in parts))
    emb, out, bias = np.zeros_like(m.emb), np.zeros_like(m.out), np.zeros_like(m.bias)
    for _, _, used, de, do, db in parts:
        emb[used] += de
        out += do
        bias += db
    adam.step(m.arrays(), [emb / n, out / n, bias / n])
    return sum(p[0] for p in parts) / n


class Scorer:
    """Scores sentences with the outputs folded into the embeddings, one short vector per remembered word."""

    def __init__(self, m: Model, cache: int = 1 << 18):
        self.table = m.emb @ m.out
        self.bias, self.subjects, self.size = m.bias, m.subjects, cache
        self._clear()

    def _clear(self) -> None:
        """Word 0 stands for none."""
        self.seen: dict[str, int] = {"": 0}
        self.vectors, self.counts = np.zeros((1024, self.table.shape[1]), np.float32), np.zeros(1024, np.int32)

    def _number(self, w: str) -> int:
        if w in self.seen:
            return self.seen[w]
        i = self.seen[w] = len(self.seen)
        if i == len(self.counts):
            self.vectors, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.vectors, self.counts))
        f = features(w)
        self.vectors[i], self.counts[i] = self.table[f].sum(0), len(f)
        return i

    def probabilities(self, sents: Sequence[str]) -> np.ndarray:
        """One row for each sentence, all of a batch at once."""
        if len(self.seen) >= self.size:
            self._clear()
        seen, number = self.seen, self._number
        occ: list[int] = []
        start = []
        for s in sents:
            start.append(len(occ))
            ids = list(map(seen.get, words(s)))
            occ += ([number(w) if i is None else i for i, w in zip(ids, words(s))] if None in ids else ids) or [0]
        if not start:
            return np.empty((0, len(self.subjects)), np.float32)
        ids, at = np.array(occ, np.int64), np.array(start, np.int64)
        z = np.add.reduceat(self.vectors[ids], at, axis=0) / np.maximum(1, np.add.reduceat(self.counts[ids], at))[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def found(self, texts: Sequence[str | None]) -> list[tuple[int, int]]:
        """(place of the text, place of the subject): subjects to which at least SHARE of a text's sentences are devoted."""
        per = [sentences(t) for t in texts]
        n = np.array([len(x) for x in per], np.int64)
        p = self.probabilities([s for x in per for s in x])
        if not len(p):
            return []
        best = p.argmax(1)
        sure = p[np.arange(len(p)), best] >= SURE
        k = len(self.subjects)
        counts = np.bincount(np.repeat(np.arange(len(per)), n)[sure] * k + best[sure], minlength=len(per) * k).reshape(-1, k)
        return [(int(i), int(j)) for i, j in np.argwhere((counts > 0) & (counts * (1 / SHARE) >= n[:, None] - 1e-9))]


#: What a worker process keeps of the latest run: its partitions' batches, and the scorer.
_KEPT: dict = {"run": None}


def _kept(run: str, key: object, make):
    if _KEPT.get("run") != run:
        _KEPT.clear()
        _KEPT["run"] = run
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def training_set(docs: DataFrame, labels: DataFrame, subjects: Sequence[str], max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, subjects) of labelled documents, at most about `max_docs` of them, drawn by the hash of their id.

    Labels of other subjects, of null and of unknown documents are left out.
    """
    by_doc = labels.where(F.col("subject").isin(*subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    n = by_doc.count()
    if n > max_docs:
        by_doc = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    # At most about MAX_TRAIN_DOCS short rows.
    return docs.select("doc_id", "text").join(F.broadcast(by_doc), "doc_id")


def train(rows: DataFrame, subjects: Sequence[str], rounds: int = ROUNDS, docs_per_partition: int = DOCS_PER_PARTITION) -> Model:
    """Synchronous training on (doc_id, text, subjects): in each round all partitions give their summed gradient.

    Texts are read once: each partition's sentences are kept as word numbers, in
    one checkpointed row, which the rounds read. Only buckets that some training
    word has are sent and updated; the others stay as they began. A gradient
    holds the embeddings its partition touches, at most BUCKETS x DIM floats, and
    partitions are as few as MAX_TRAIN_DOCS allows. Without a row the model stays
    as it began and finds no subject.
    """
    spark = rows.sparkSession
    names = tuple(subjects)
    rows = cut(rows.select("doc_id", "text", "subjects"))
    partitions = max(1, math.ceil(rows.count() / docs_per_partition))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = ((sentences(t), np.array([x in set(s) for x in names], np.float32)) for pdf in batches for t, s in zip(pdf["text"], pdf["subjects"]))
        b = Batch.of(docs, len(names))
        yield pd.DataFrame({"payload": [b.payload()], "used": [b.used.astype(np.int32).tobytes()]})

    held = cut(rows.repartition(partitions, "doc_id").mapInPandas(read, "payload binary, used binary"))
    run = uuid.uuid4().hex
    whole = Model.start(names)
    # At most BUCKETS numbers for each partition.
    buckets = np.unique(np.concatenate([np.empty(0, np.int32), *(np.frombuffer(r.used, np.int32) for r in held.select("used").collect())]))
    places = spark.sparkContext.broadcast(buckets)
    model = Model(whole.emb[buckets], whole.out, whole.bias, names)
    adam = Adam(model.arrays(), RATE)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def grad(batches: Iterator[pd.DataFrame], sent=sent, r=r) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            for i, payload in enumerate(x for pdf in batches for x in pdf["payload"]):
                b = _kept(run, (TaskContext.get().partitionId(), i), lambda payload=payload: Batch.read(payload, places.value))
                loss, n, used, de, do, db = gradient(sent.value, b, r >= RELABEL_FROM)
                yield pd.DataFrame({"loss": [loss], "n": [n], "used": [used.astype(np.int32).tobytes()], "de": [de.astype(np.float32).tobytes()], "do": [do.astype(np.float32).tobytes()], "db": [db.astype(np.float32).tobytes()]})

        parts = held.select("payload").mapInPandas(grad, "loss double, n long, used binary, de binary, do binary, db binary").collect()
        k = len(names)
        array = lambda b, kind: np.frombuffer(b, kind)
        update(model, adam, [(p.loss, p.n, array(p.used, np.int32), array(p.de, np.float32).reshape(-1, DIM), array(p.do, np.float32).reshape(DIM, k), array(p.db, np.float32)) for p in parts])
        sent.destroy()
    places.destroy()
    whole.emb[buckets] = model.emb
    return Model(whole.emb, model.out, model.bias, names)


def assign(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject): one row for each subject of each document; whole texts, no shuffle.

    A document has a subject if at least SHARE of its sentences are devoted to
    it; documents without sentences (null, blank, tables or code only) have none.
    """
    run = uuid.uuid4().hex
    model_subjects = model.subjects
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _kept(run, "scorer", lambda: Scorer(sent.value))
        for pdf in batches:
            got = scorer.found(pdf["text"].tolist())
            if not got:
                continue
            ids = pdf["doc_id"].to_numpy()
            yield pd.DataFrame({"doc_id": ids[[i for i, _ in got]], "subject": [model_subjects[j] for _, j in got]})

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run_batches, "doc_id long, subject string")
