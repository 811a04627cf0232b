"""Quality scores: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import documents
from .kernel import U

#: Word vectors: rows of the table (words share them by hash), dimensions, non-zeros of an index vector, context either side.
BUCKETS, DIMS, NONZERO, CONTEXT = 1 << 14, 64, 4, 2
#: At most so many labelled rows, those least by a digest of their id, are learned from.
LEARN_ROWS = 8192
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 0.01, 1e-4, 7
THRESHOLD = 0.3
FOLDS = 5
SLICE = 1 << 18

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of all tokens (runs of letters, of digits or of marks) and each text's first token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return (kernel.span_hashes(data, starts, ends) % U(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each table row the places and signs of its sparse random index vector."""
    seeds = kernel.mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + U(0x51ED270B)).reshape(BUCKETS, NONZERO)
    return (seeds % U(DIMS)).astype(np.int64), np.where(seeds >> U(63), 1, -1).astype(np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """The summed index vectors of every word's neighbours over all texts; BUCKETS x DIMS whatever the input.

    Each task sums its texts into one table and sends its non-zero rows; rows are summed again by
    number. Only the final table, of fixed size, comes to the driver.
    """

    def partial(batches):
        places, signs = index_vectors()
        table = np.zeros(BUCKETS * DIMS, np.int64)
        for batch in batches:
            for _, data, offsets in kernel.slices(batch.column(0)):
                rows, first = tokens(data, offsets)
                own = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, CONTEXT + 1):
                    same = own[step:] == own[:-step]
                    left, right = rows[:-step][same], rows[step:][same]
                    for k in range(NONZERO):
                        np.add.at(table, left * DIMS + places[right, k], signs[right, k])
                        np.add.at(table, right * DIMS + places[left, k], signs[left, k])
        yield from emit(table.reshape(BUCKETS, DIMS))

    def emit(table):
        some = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(some), 4096):
            own = some[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own % 64), pa.array(own), pa.array([r.tobytes() for r in table[own]], pa.binary())], ["part", "row", "sums"])

    def combine(batches):
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, sums in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new = np.frombuffer(sums, np.int64)
                table[row] = table[row] + new if row in table else new
        for row, sums in table.items():
            yield pa.RecordBatch.from_arrays([pa.array([row % 64]), pa.array([row]), pa.array([sums.tobytes()], pa.binary())], ["part", "row", "sums"])

    shape = "part long, row long, sums binary"
    summed = docs.select("text").mapInArrow(partial, shape).repartition("part").mapInArrow(combine, shape)
    out = np.zeros((BUCKETS, DIMS))
    for r in summed.collect():  # at most BUCKETS rows of fixed length
        out[r["row"]] = np.frombuffer(r["sums"], np.int64)
    return out


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit context vectors beside each row's own index vector."""
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs / np.sqrt(NONZERO))
    return np.hstack([table / np.maximum(norm, 1e-9), own]).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What is pooled from the word vectors of each text of a slice; zeros for a text without tokens.

    The mean vector; the lengths of its two halves, which grow as few words make up the text; the mean
    likeness of own vectors one and two places apart, which grows as words repeat in a row; log tokens.
    """
    rows, first = tokens(data, offsets)
    n, half = len(offsets) - 1, vectors.shape[1] // 2
    out, near = np.zeros((n, vectors.shape[1])), np.zeros((n, 2))
    for at in range(0, len(rows), 1 << 16):  # bounded memory for a very long text
        part = vectors[rows[at : at + (1 << 16) + 2]]
        size = min(len(rows) - at, 1 << 16)
        edge = np.clip(first - at, 0, size)
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if not len(some):
            continue
        out[some] += np.add.reduceat(part[:size].astype(np.float64), edge[:-1][some], axis=0)
        for k in (1, 2):
            alike = np.zeros(size)
            pair = np.einsum("ij,ij->i", part[:-k, half:], part[k:, half:])[:size]
            alike[: len(pair)] = pair
            ends = first[1:][(first[1:] > at) & (first[1:] <= at + size + k)] - at
            for back in range(1, k + 1):
                last = ends - back
                alike[last[(last >= 0) & (last < size)]] = 0
            near[some, k - 1] += np.add.reduceat(alike, edge[:-1][some])
    count = np.maximum(np.diff(first), 1)[:, None]
    out, near = out / count, near / count
    lengths = np.stack([np.linalg.norm(out[:, :half], axis=1), np.linalg.norm(out[:, half:], axis=1)], axis=1)
    return np.hstack([out, lengths, near, np.log1p(np.diff(first))[:, None]])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A two-layer network by Adam on four fifths of the rows and a temperature that fits the last fifth."""
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / std
    held, train = order[:cut], order[cut:]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            xb, yb = x[train[at : at + BATCH]], y[train[at : at + BATCH]]
            h = np.tanh(xb @ w[0] + w[1])
            g = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - yb) / len(yb)
            back = np.outer(g, w[2]) * (1 - h * h)
            t += 1
            for i, d in enumerate((xb.T @ back + DECAY * w[0], back.sum(axis=0), h.T @ g + DECAY * w[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    z = np.tanh(x[held] @ w[0] + w[1]) @ w[2] + w[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * z / s)) for s in grid]
    return {"mean": mean, "std": std, "w": w, "temperature": float(grid[int(np.argmin(loss))])}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """The calibrated probability of label 1."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    w = model["w"]
    z = np.tanh((x - model["mean"]) / model["std"] @ w[0] + w[1]) @ w[2] + w[3]
    return 1 / (1 + np.exp(-np.clip(z / model["temperature"], -60, 60)))


def _held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, dict]:
    """Word vectors of all texts and a network fitted on labelled rows outside the held-out fold.

    Labels that are null or belong to no document are left out; of several labels of a document the least counts.
    At most LEARN_ROWS rows are used. With labels of one kind, or none, the score is constant.
    """
    vectors = word_vectors(context_table(docs))
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(label).cast("double").alias("y"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(LEARN_ROWS)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)  # BUCKETS x 2 DIMS floats

    def features(batches):
        for batch in batches:
            for row, data, offsets in kernel.slices(batch.column(2), SLICE):
                got = pooled(data, offsets, shared.value)
                n = len(got)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(list(got), pa.list_(pa.float64()))], ["id", "y", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(features, "id long, y double, x array<double>")
    rows = sample.dropDuplicates(["id"]).collect()  # LEARN_ROWS at most
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), vectors.shape[1] + 5)
    return vectors, fit(x, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, vectors: np.ndarray, model: dict, threshold: float = THRESHOLD, payload: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text; with ``payload`` only the table's own
    columns, of the rows predicted 1.

    A null text counts as empty and an empty one is scored from a zero vector. A null id is never held
    out. Repeated rows each get the same score; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    source = docs if payload else docs.select("doc_id", _held_out().alias("held_out"), "text")
    at = source.columns.index("text")

    def run(batches):
        for batch in batches:
            parts = [probability(shared.value[1], pooled(data, offsets, shared.value[0])) for _, data, offsets in kernel.slices(batch.column(at), SLICE)]
            got = np.concatenate(parts) if parts else np.zeros(0)
            if payload:
                yield batch.filter(pa.array(got >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, docs.schema if payload else "doc_id long, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored as labels.quality marks them."""
    docs = documents(spark, sf_dir)
    return score(docs, *learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
