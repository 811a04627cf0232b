"""Hard-negative mining over inverted lists of a k-means index, exact by Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
QUERY_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 80, 100
#: Rows of a list's piece, anchors of a block, and the most lists of all dimensions together.
LIST_ROWS, BLOCK_ROWS, LISTS = 4096, 256, 1024
#: Vectors that centroids are fitted on, at most: those least by a digest of their row; and rounds of Lloyd's algorithm.
LEARN_ROWS, ROUNDS = 16_384, 8
#: Bytes of all centroids, or of the vectors they are fitted on, at most.
LEARN_BYTES = 32 << 20
#: Lists that are visited first, to have a bound for all others.
PROBES = 4
#: Larger squared norms could give scores that no long holds.
NORM = float(1 << 62)
#: Below this squared norm all sums of products are exact in double precision.
EXACT = float(1 << 53)


def integers(table: DataFrame, scale: int = SCALE, shift_every: int = SHIFT_EVERY, labels: int = LABELS) -> DataFrame:
    """row, vec_id, label, dims, vector (packed int64 of floor(scale * x)) of the rows that take part."""

    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            x = np.floor(np.float64(scale) * flat)
            norms = np.add.reduceat(np.append(x * x, 0.0), at[:-1]) if len(sizes) else np.zeros(0)
            keep = np.flatnonzero((sizes > 0) & (norms < NORM))
            vectors = [x[at[i] : at[i + 1]].astype(np.int64).tobytes() for i in keep]
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), pa.array(sizes[keep].astype(np.int32)), pa.array(vectors, pa.binary())], ["row", "vec_id", "label", "dims", "vector"])

    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.col("label").cast("long").alias("label"))
    sound = sound.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    shifted = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return sound.select("row", "vec_id", "embedding", shifted.alias("label")).mapInArrow(pack, "row long, vec_id long, label long, dims int, vector binary")


def fit_lists(vectors: DataFrame, learn_rows: int = LEARN_ROWS, list_rows: int = LIST_ROWS, lists: int = LISTS) -> dict[int, np.ndarray]:
    """Centroids of each number of dimensions, the origin first, fitted on a bounded sample.

    A sample that lacks some dimensions leaves them the origin alone, so that any row has a list.
    """
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("d")).first()
    many = max(1, min(learn_rows, LEARN_BYTES // (8 * (size["d"] or 1))))
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(many).select("dims", "vector").toPandas()
    found = {}
    for dims, own in sample.groupby("dims"):
        x = np.stack([np.frombuffer(v, np.int64) for v in own["vector"]]).astype(np.float64)
        share = len(x) / len(sample)
        k = int(min(max(1, share * lists), max(1, share * size["n"] / list_rows), len(x) / 4 + 1))
        rng = np.random.default_rng(11)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = _nearest(x, c)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            n = np.bincount(near, minlength=k)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        found[int(dims)] = np.concatenate([np.zeros((1, x.shape[1])), c])
    return found


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2.0 * (x @ c.T), axis=1)


def build_lists(vectors: DataFrame, centroids: dict[int, np.ndarray], list_rows: int = LIST_ROWS) -> DataFrame:
    """One row for each piece of a list: dims, list, piece, centre, radius, n and the packed rows, ids, labels and vectors.

    A vector enters the list of its nearest centroid. A list of more than ``list_rows`` vectors is dealt by a digest of the row to
    pieces of about so many, each with a radius of its own, so no group grows with the input.
    """

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(3).to_numpy()
            own, held = np.zeros(len(dims), np.int32), batch.column(4)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in centroids:
                    x = np.stack([np.frombuffer(held[i].as_buffer(), np.int64) for i in at.tolist()]).astype(np.float64)
                    own[at] = _nearest(x, centroids[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "list"])

    def pack(key, table):
        cols = {n: table.column(n).to_numpy() for n in ("row", "vec_id", "label")}
        d, own, piece = (k.as_py() for k in key)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int64).reshape(-1, d)
        centre = centroids[d][own] if d in centroids else np.zeros(d)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        whole = [[d], [own], [piece], [centre.tobytes()], [radius], [len(x)], *[[cols[n].tobytes()] for n in ("row", "vec_id", "label")], [x.tobytes()]]
        return pa.Table.from_arrays([pa.array(w, t) for w, t in zip(whole, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names)

    names = ["dims", "list", "piece", "centre", "radius", "n", "rows", "ids", "labels", "vectors"]
    dealt = written(vectors.mapInArrow(assign, "row long, vec_id long, label long, dims int, vector binary, list int"), "dealt")
    sizes = dealt.groupBy("dims", "list").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("pieces"))
    dealt = dealt.join(sizes, ["dims", "list"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    return dealt.groupBy("dims", "list", "piece").applyInArrow(pack, "dims int, list int, piece int, centre binary, radius double, n long, rows binary, ids binary, labels binary, vectors binary")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in double precision where those are exact."""
    big = max(float((q.astype(np.float64) ** 2).sum(axis=1).max()), float((x.astype(np.float64) ** 2).sum(axis=1).max()))
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if big < EXACT else q @ x.T


def _bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most a list's vectors can score with each query: q.c minus and plus |q| r, widened by the rounding."""
    q = q.astype(np.float64)
    middle, norm = q @ centre.T, np.sqrt((q * q).sum(axis=1))[:, None]
    reach = norm * radius * (1 + 1e-9) + 1e-9 * norm * np.sqrt((centre * centre).sum(axis=1)) + 1.0
    return middle - reach, middle + reach


ASK = "ask long, slot int, own_row long, label long, same boolean, dims int, low double, high double, floor double, vector binary"


def _visits(asks: DataFrame, lists: DataFrame, k: int, every_list: bool, block_rows: int) -> DataFrame:
    """(ask, slot, score, vec_id, row): of the lists that an ask visits, its k best rows with low <= score <= high.

    An ask holds its vector, the label its rows must have or must not have, the window of scores, and ``floor``, its kth score so
    far. Lists are skipped where their bounds lie outside the window or strictly below that score, and ranked by their upper bound: the first PROBES
    are visited while there is no kth score, all others (``every_list``) once there is.

    Bounds are taken from the table of lists, as many as there are centroids, for blocks of asks; an ask goes to the pieces of the lists that it
    has to visit, and a task streams the asks of a piece past the piece, which comes first in the order, so that it holds one piece and
    one block at a time.
    """
    heads = lists.groupBy("dims", "list").agg(F.first("centre"), F.max("radius"), F.max("piece")).collect()

    def route(batches):
        known = table = None
        for batch in batches:
            for d in np.unique(batch.column("dims").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("dims").to_numpy() == d))
                known = known or head_rows()
                if d not in known:
                    continue
                numbers, centre, radius = known[d]
                q = np.stack([np.frombuffer(v.as_buffer(), np.int64) for v in own.column("vector")])
                low, high, floor = (own.column(c).to_numpy()[:, None] for c in ("low", "high", "floor"))
                for at in range(0, len(q), block_rows):
                    part = slice(at, at + block_rows)
                    least, most = _bounds(q[part], centre, radius)
                    may = (most >= low[part]) & (least <= high[part])
                    rank = np.argsort(np.argsort(-np.where(may, most, -np.inf), axis=1, kind="stable"), axis=1, kind="stable")
                    may &= (rank >= PROBES) & (most >= floor[part]) if every_list else rank < PROBES
                    i, j = np.nonzero(may)
                    order = np.argsort(j, kind="stable")
                    table = own.slice(at, block_rows).take(pa.array(i[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[j[order], 0]), pa.array(numbers[j[order], 1]), *table.columns], ["list", "last", *table.schema.names])

    def head_rows():
        by: dict[int, list] = {}
        for r in heads_here.value:
            by.setdefault(r[0], []).append(r)
        return {d: (np.array([(r[1], r[4]) for r in rs], np.int32), np.stack([np.frombuffer(r[2]) for r in rs]), np.array([r[3] for r in rs])) for d, rs in by.items()}

    place = (F.col("list").cast("long") * (1 << 31) + F.col("piece")).alias("place")
    heads_here = lists.sparkSession.sparkContext.broadcast([tuple(r) for r in heads])
    names = [c.split()[0] for c in ASK.split(", ")]
    routed = asks.select(*names).mapInArrow(route, "list int, last int, " + ASK)
    asked = routed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last")))).select(place, *names)
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ASK.split(", ")}
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("rows", "binary"), ("ids", "binary"), ("labels", "binary"), ("vectors", "binary"))]
    both = lists.select(place, *[(F.col("dims") if c == "dims" else v).alias(c) for c, v in empty.items()], "rows", "ids", "labels", "vectors").unionByName(asked.select("*", *nothing))

    def answer(batches):
        held = here = None
        for batch in batches:
            whole = batch.column("vectors").is_valid().to_numpy(zero_copy_only=False)
            at = np.stack([batch.column(c).to_numpy() for c in ("dims", "place")])
            edges = np.concatenate([np.flatnonzero(whole), np.flatnonzero(whole) + 1, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1])
            starts = np.unique(np.concatenate([edges[edges < batch.num_rows], np.arange(0, batch.num_rows, block_rows)])).astype(int)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if whole[a]:
                    d, here = int(at[0, a]), tuple(at[:, a])
                    held = [np.frombuffer(batch.column(c)[int(a)].as_py(), np.int64) for c in ("rows", "ids", "labels")] + [np.frombuffer(batch.column("vectors")[int(a)].as_py(), np.int64).reshape(-1, d)]
                    continue
                if tuple(at[:, a]) == here:  # a piece to which no row was dealt has no answers
                    yield from _best(batch.slice(a, b - a), held, k)

    dealt = both.repartition("dims", "place").sortWithinPartitions("dims", "place", F.col("vectors").isNull())
    return dealt.mapInArrow(answer, "ask long, slot int, score long, vec_id long, row long")


def _best(part: pa.RecordBatch, held: list, k: int):
    """The k best rows of one piece for each ask of a batch; the piece's rows are in no order."""
    rows, ids, labels, x = held
    q = np.stack([np.frombuffer(v.as_buffer(), np.int64) for v in part.column("vector")])
    s = _scores(q, x)
    own, label, same, low, high = (part.column(c).to_numpy(zero_copy_only=False) for c in ("own_row", "label", "same", "low", "high"))
    fit = ((labels[None, :] == label[:, None]) == same[:, None]) & (rows[None, :] != own[:, None]) & (s >= low[:, None]) & (s <= high[:, None])
    i, j = np.nonzero(fit)
    order = np.lexsort((rows[j], ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    i, j = i[keep], j[keep]
    picked = part.take(pa.array(i))
    yield pa.RecordBatch.from_arrays([picked.column("ask"), picked.column("slot"), pa.array(s[i, j]), pa.array(ids[j]), pa.array(rows[j])], ["ask", "slot", "score", "vec_id", "row"])


def _search(asks: DataFrame, lists: DataFrame, k: int, block_rows: int) -> DataFrame:
    """ask, slot, near (the k best as structs of score, vec_id, row; best first) of every ask with any, through two rounds of visits."""
    best = Window.partitionBy("ask", "slot").orderBy(F.col("score").desc(), "vec_id", "row")
    top = lambda t: t.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = written(top(_visits(asks, lists, k, False, block_rows)).drop("rank"), "probed")
    kth = first.groupBy("ask", "slot").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    floor = F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))
    again = asks.join(kth.select("ask", "slot", "least"), ["ask", "slot"], "left").withColumn("floor", floor).select(*[c.split()[0] for c in ASK.split(", ")])
    return written(top(first.unionByName(_visits(again, lists, k, True, block_rows))), "found")


def hard_negatives(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = QUERY_EVERY, low: int = LOW, high: int = HIGH, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor, a row whose vec_id is divisible by
    ``every``, and each of its positives, the best rows of another label that score from ``low`` to ``high`` hundredths of the positive.

    Scores are integer inner products of the scaled components; higher is better, ties go to the smaller vec_id, then the row read
    first. Rows with a null id, label, vector or component, a non-finite component, no component, or a squared norm of 2^62 or more (a score
    may not fit a long) take no part; only vectors of one length meet. An anchor's positives are other rows, so a repeated
    row is one, and each row of a repeated anchor is an anchor of its own. A positive without a negative gives no row; neither does an empty table.

    The result is exact: centroids are fitted on a bounded sample, but every row is in a list, and a list is left out only
    where its bound says that it can't matter. Anchors go to lists in blocks; no list, block or window of a ranking grows with the input.
    """
    vectors = written(integers(table), "integers")
    lists = written(build_lists(vectors, fit_lists(vectors, learn_rows, list_rows), list_rows), "lists")
    anchors = vectors.where(F.col("vec_id") % every == 0)
    no = F.lit(float("-inf"))

    def ask(slot: Column, label: Column, same: bool, least: Column, most: Column) -> list[Column]:
        return [F.col("row").alias("ask"), slot.cast("int").alias("slot"), F.col("row").alias("own_row"), label.alias("label"), F.lit(same).alias("same"), F.col("dims"), least.alias("low"), most.alias("high"), no.alias("floor"), F.col("vector")]

    near = _search(anchors.select(*ask(F.lit(0), F.col("label"), True, no, F.lit(float("inf")))), lists, positives, block_rows)
    pairs = near.select(F.col("ask").alias("row"), F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # least and greatest whole scores of the window, in decimals since a score times a hundred may not fit a long
    wide = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(wide * low / 100).cast("double"), F.floor(wide * high / 100).cast("double")
    windows = anchors.join(pairs, "row").where(least <= most)
    far = _search(windows.select(*ask(F.col("slot"), F.col("label"), False, least, most)), lists, negatives, block_rows)
    named = pairs.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").withColumnRenamed("row", "ask")
    return named.join(far.select("ask", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["ask", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose id is divisible by 100."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id, n.br) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.ar = n.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id, n.br) <= 5
"""
