"""Quality classifier: a factorisation machine.

Inputs of a score are the words of the whole text, hashed to ``BUCKETS`` buckets,
structure statistics, and as metadata the text's length and the shape of its
lines; labels, lang, source and ids are not. Every
pair of inputs interacts through low-rank factors, and the sum over all pairs is
taken in linear time: half of (square of the sum minus sum of the squares), for
each factor.

The machine is trained with MLlib on a bounded sample of labelled rows:
``TRAIN_ROWS`` rows at most, drawn by hash of the id, and never one whose
crc32(doc_id as text) mod 4 is 2. Scoring is one map over the texts.

Edge cases: a null or empty text is scored from its (zero) statistics; rows with
null labels or ids are not used for training; repeated rows are scored alike;
with labels of one class only, or none, every score is that class's share
(0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import freed
from tessera.session import bound_batches, materialize, scratch

BUCKETS, FACTORS, TRAIN_ROWS = 512, 4, 4_000
ITERATIONS, STEP, PENALTY, THRESHOLD = 40, 0.2, 0.0005, 0.7
SYMBOLS = frozenset(b"#*$%&|<>~^=_\\{}[]@")
N_STATS = 19


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


#: byte -> class: 1 upper case, 2 digit, 3 symbol, 4 sentence mark, 5 beyond ASCII
CLASSES = np.zeros(256, dtype=np.uint8)
CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 5
CLASSES[list(SYMBOLS)] = 3
CLASSES[list(b".,;:!?")] = 4


def statistics(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text as numbers between 0 and about 1."""
    n, size = len(words), len(data)
    kinds = np.bincount(CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=6) if size else np.zeros(6)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(lines))
    shouted = data.count(b"!")
    top = counts.most_common(2)
    return [
        np.log1p(n) / 12,
        np.log1p(size) / 14,
        _share(kinds[1], size) * 2,
        _share(kinds[2], size) * 2,
        min(1.0, _share(kinds[3], n)),
        min(1.0, _share(kinds[4], n)),
        _share(kinds[5], size),
        min(1.0, _share(shouted, n)),
        1 - _share(distinct, len(lines)),
        _share(len(counts), n),
        min(1.0, _share(size, n) / 20),
        min(1.0, _share(len(lines), n) * 4),
        _share(top[0][1], n) if top else 0.0,
        _share(sum(c for _, c in top), n),
        float(n < 20),
        min(1.0, _share(data.count(b"|"), n)),
        np.log1p(_share(sum(map(len, lines)), len(lines))) / 10,
        _share(sum(len(x) < 40 for x in lines), len(lines)),
        _share(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), len(lines)),
    ]


def featurize(text: str | None, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): statistics first, then hashed words with unit length."""
    data = (text or "").encode()
    words = data.split()
    counts = Counter(words)
    weights: dict[int, float] = {}
    for word, count in counts.items():
        bucket = memo.get(word)
        if bucket is None:
            bucket = memo[word] = xxhash.xxh32_intdigest(word.lower()) % BUCKETS
        weights[bucket] = weights.get(bucket, 0.0) + count
    ids = np.fromiter(weights.keys(), dtype=np.int32, count=len(weights))
    values = np.sqrt(np.fromiter(weights.values(), dtype=np.float64, count=len(weights)))
    values /= np.sqrt((values**2).sum()) if len(values) else 1
    return np.concatenate([np.arange(N_STATS, dtype=np.int32), ids + N_STATS]), np.concatenate([statistics(data, words, counts), values])


MEMO_WORDS = 200_000


def _featurized(texts: list[str | None], memo: dict[bytes, int]):
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return [featurize(t, memo) for t in texts]


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # one row per input

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        weighted = self.factors[ids] * values[:, None]
        pairs = 0.5 * ((weighted.sum(axis=0) ** 2).sum() - (weighted**2).sum())
        raw = self.bias + self.linear[ids] @ values + pairs
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


def constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(N_STATS + BUCKETS), np.zeros((N_STATS + BUCKETS, FACTORS)))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """label and inputs of a bounded sample of labelled rows outside the held-out part."""
    bound_batches(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("double").alias("label"))
    n = usable.count()
    if n > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    usable = materialize(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "quality-labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            ids, values = zip(*_featurized(batch["text"].to_pylist(), memo), strict=True) if batch.num_rows else ((), ())
            # Sparse vectors: in order, and without zeros, which MLlib's gradient can't take.
            order = [o[v[o] != 0] for o, v in ((np.argsort(i), v) for i, v in zip(ids, values, strict=True))]
            columns = [pa.array([i[o] for i, o in zip(ids, order, strict=True)], pa.list_(pa.int32())), pa.array([v[o] for v, o in zip(values, order, strict=True)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch["label"], *columns], names=["label", "ids", "values"])

    # The sampled labels have at most about max_rows rows, so this side may be broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("label", "text")
    return materialize(joined.mapInArrow(lambda it: freed(run(it)), "label double, ids array<int>, values array<double>"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Machine:
    """Train on a bounded sample of labelled rows (see the module's text). Runs jobs; its tables are deleted."""
    with scratch(docs.sparkSession):
        return _fitted(training_rows(docs, labels, max_rows))


def _fitted(sample: DataFrame) -> Machine:
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import SparseVector, VectorUDT

    shares = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return constant(next(iter(shares), 0.5))
    # Only the sample's rows, at most about TRAIN_ROWS, become vectors row by row.
    vector = F.udf(lambda ids, values: SparseVector(N_STATS + BUCKETS, ids, values), VectorUDT())
    train = sample.select("label", vector("ids", "values").alias("features")).coalesce(4)
    machine = FMClassifier(
        factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=PENALTY, initStd=0.05, miniBatchFraction=1.0, tol=1e-4, solver="adamW", seed=11
    ).fit(train)
    return Machine(machine.intercept, machine.linear.toArray(), machine.factors.toArray())


def _scores(batch: pa.RecordBatch, machine: Machine, memo: dict[bytes, int]) -> list[float]:
    return [machine.score(*x) for x in _featurized(batch["text"].to_pylist(), memo)]


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(batch, machine, memo), pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: freed(run(it)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold; verdicts are made on the row, nothing is joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            yield batch.filter(pa.array([s >= threshold for s in _scores(batch, machine, memo)], pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: freed(run(it)), docs.schema)
