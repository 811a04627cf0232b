"""Approximate nearest neighbours: a navigable small-world graph for each shard, with shard results merged."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

NEAREST = 10
QUERY_EVERY = 100
#: The most vectors of a shard and their bytes, of which it has as many as fit; query classes in a block.
SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS = 1 << 14, 32 << 20, 512
#: Links of a node on upper layers (twice as many on the lowest), candidates weighed for them, width of a search.
LINKS, WEIGHED, BEAM = 16, 64, 128
#: Nodes that enter a graph together at most.
BATCH = 256
#: Nodes whose neighbours a search looks at in one step.
TOGETHER = 4


def _sound(batch: pa.RecordBatch):
    """(ids, list of float64 vectors) of the rows that take part."""
    ids, lists = batch.column(0), batch.column(1)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0
    at = np.concatenate([[0], np.cumsum(size)])
    within = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[at])
    keep = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (within(~np.isfinite(x)) == 0) & (within(x != 0) > 0))
    return ids.take(pa.array(keep)).to_pylist(), [x[at[r] : at[r + 1]] for r in keep.tolist()]


def _key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _apart(vectors: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of nodes ``at``."""
    return ((vectors[at] - queries[:, None, :]) ** 2).sum(axis=2)


def _chosen(vectors: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Which candidates each row links to: nearest first, at most ``most``, none nearer to a link already chosen than to the row.

    ``near``: candidate nodes by distance, ``far``: the squared distances, infinite where there is no candidate.
    """
    own = vectors[near]
    square = (own * own).sum(axis=2)
    between = square[:, :, None] + square[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    blocked = ~np.isfinite(far)
    out = np.zeros(near.shape, bool)
    taken = np.zeros(len(near), int)
    for c in range(near.shape[1]):
        good = ~blocked[:, c] & (taken < most)
        out[good, c] = True
        taken += good
        blocked |= good[:, None] & (between[:, c, :] <= far)
    return out


def _descended(queries: np.ndarray, vectors: np.ndarray, tables: list[np.ndarray], down_to: int, entry: int = 0) -> np.ndarray:
    """The node at which a greedy walk from the entry through the layers above ``down_to`` ends, for each query.

    Nodes are places in the order of entry, in which those of a layer come before all others.
    """
    at = np.full(len(queries), entry)
    best = _apart(vectors, at[:, None], queries)[:, 0]
    for table in tables[: down_to : -1]:
        live = np.arange(len(queries))
        while len(live):
            next_ = table[at[live]]
            d = np.where(next_ >= 0, _apart(vectors, np.maximum(next_, 0), queries[live]), np.inf)
            c = d.argmin(axis=1)
            d = d[np.arange(len(live)), c]
            better = d < best[live]
            live, c, d, next_ = live[better], c[better], d[better], next_[better]
            best[live] = d
            at[live] = next_[np.arange(len(live)), c]
    return at


def _walked(queries: np.ndarray, vectors: np.ndarray, table: np.ndarray, start: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, nodes) of the ``width`` nearest of the first ``n`` nodes met from ``start``, nearest first; all queries step together."""
    q = len(queries)
    dist, node, done = np.full((q, width), np.inf), np.full((q, width), -1), np.ones((q, width), bool)
    dist[:, 0], node[:, 0], done[:, 0] = _apart(vectors, start[:, None], queries)[:, 0], start, False
    met = np.zeros((q, n), bool)
    met[np.arange(q), start] = True
    live = np.arange(q)
    while len(live):
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :TOGETHER]  # the nearest open ones
        open_ = ~np.take_along_axis(done[live], pick, 1)
        some = open_.any(axis=1)
        live, pick, open_ = live[some], pick[some], open_[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        next_ = np.where(open_[:, :, None], table[node[live[:, None], pick]], -1).reshape(len(live), -1)
        r, c = np.nonzero((next_ >= 0) & ~met[live[:, None], np.maximum(next_, 0)])
        _, once = np.unique(r * n + next_[r, c], return_index=True)
        r, c = r[once], c[once]
        new = np.zeros(next_.shape, bool)
        new[r, c] = True
        met[live[r], next_[r, c]] = True
        d = np.full(next_.shape, np.inf)
        d[r, c] = ((vectors[next_[r, c]] - queries[live[r]]) ** 2).sum(axis=1)
        every = np.hstack([dist[live], d])
        order = np.argsort(every, axis=1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(every, order, 1)
        node[live] = np.take_along_axis(np.hstack([node[live], next_]), order, 1)
        done[live] = np.take_along_axis(np.hstack([done[live], ~new]), order, 1)
    return dist, node


def _linked(vectors: np.ndarray, table: np.ndarray, far: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
    """Add links a -> b of squared length d to the flat arrays; a node that gets more than its share chooses anew among all it has."""
    width = table.shape[1]
    room = width + width // 4  # the nearest that a full node weighs
    own = np.unique(a)
    has = table[own] >= 0
    a = np.concatenate([np.repeat(own, has.sum(axis=1)), a])
    b, d = np.concatenate([table[own][has], b]), np.concatenate([far[own][has], d])
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    row = np.searchsorted(own, a)
    place = np.arange(len(a)) - np.searchsorted(a, own)[row]
    keep = place < room
    near, apart = np.full((len(own), room), -1), np.full((len(own), room), np.inf, np.float32)
    near[row[keep], place[keep]], apart[row[keep], place[keep]] = b[keep], d[keep]
    full = np.flatnonzero(np.isfinite(apart[:, width:]).any(axis=1))
    for at in range(0, len(full), BATCH):
        rows = full[at : at + BATCH]
        pick = _chosen(vectors, np.maximum(near[rows], 0), apart[rows], width)
        order = np.argsort(~pick, axis=1, kind="stable")  # the chosen first, then the nearest of the rest fill up
        near[rows], apart[rows] = np.take_along_axis(near[rows], order, 1), np.take_along_axis(apart[rows], order, 1)
    table[own], far[own] = near[:, :width], apart[:, :width]


def build_graph(vectors: np.ndarray, links: int = LINKS, weighed: int = WEIGHED, batch: int = BATCH) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """(order of entry, nodes in each layer, flat neighbour array of each layer) of one shard.

    A node's top layer is drawn, layers thinning out geometrically; nodes enter from the highest down, so that a layer
    is a prefix of the order, in which neighbours are numbered. A node finds its candidates by searching the graph as it
    stands: greedily through the layers above, then with a beam of ``weighed`` through its own. Nodes enter in batches that are at most as
    large as the graph, and those of one batch also weigh each other. A node links to at most ``links`` candidates
    (``_chosen``), and they to it. Neighbour arrays have a fixed width; -1 fills up. The cost of a node follows the search, not the shard.
    """
    n = len(vectors)
    draws = np.random.default_rng(n).random(n)
    level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(int), 6)
    order = np.argsort(-level, kind="stable")
    own = vectors[order].astype(np.float32)
    sizes = [int((level >= depth).sum()) for depth in range(int(level.max()) + 1)]
    tables: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(sizes)
    for depth in range(len(sizes) - 1, -1, -1):
        size, width = sizes[depth], links * 2 if depth == 0 else links
        above = sizes[depth + 1] if depth + 1 < len(sizes) else 0
        table, far = np.full((size, width), -1, np.int32), np.full((size, width), np.inf, np.float32)
        tables[depth] = table
        a = 0
        while a < size:
            b = min(size, a + min(batch, max(a, weighed)))
            b = above if a < above < b else b
            new = own[a:b]
            near, apart = np.zeros((b - a, 0), np.int64), np.zeros((b - a, 0))
            if a:
                # those of the layer above are where a walk through it ends, so they enter from the first node
                start = _descended(new, own, tables, depth) if a >= above else np.zeros(b - a, np.int64)
                apart, near = _walked(new, own, table, start, min(weighed, a), a)
            square = (new * new).sum(axis=1)
            among = np.maximum(square[:, None] + square[None, :] - 2 * new @ new.T, 0)
            among[np.triu_indices(b - a)] = np.inf  # the earlier ones of the batch
            near = np.hstack([near, np.broadcast_to(np.arange(a, b), among.shape)])
            apart = np.hstack([apart, among])
            count = min(weighed, apart.shape[1])
            best = np.argpartition(apart, count - 1, axis=1)[:, :count]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(apart, best, 1), axis=1, kind="stable"), 1)
            near, apart = np.take_along_axis(near, best, 1), np.take_along_axis(apart, best, 1).astype(np.float32)
            row, at = np.nonzero(_chosen(own, np.maximum(near, 0), apart, links))
            left, right, d = row + a, near[row, at], apart[row, at]
            if len(left):
                _linked(own, table, far, np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([d, d]))
            a = b
    return order, sizes, tables


def search_graph(queries: np.ndarray, vectors: np.ndarray, tables: list[np.ndarray], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, nodes) of the ``beam`` nearest nodes met, nearest first; ``vectors`` are in the order of entry."""
    start = _descended(queries, vectors, tables, 0)
    return _walked(queries, vectors, tables[0], start, min(beam, len(vectors)), len(vectors))


def nearest(table: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its ``k`` nearest rows.

    Equal vectors form one class, of which the k + 1 smallest ids are enough for any answer; classes are
    dealt by digest to shards of about ``shard_rows`` (fewer where so many would exceed SHARD_BYTES), each indexed by a graph. Blocks of query classes
    meet every shard, and each class merges the shards' best by distance, then id, before its queries take their rows.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; only
    vectors of one length are compared. Each row is a candidate and a query of its own, be its id or its vector that of another: a query leaves out
    one row of its id and vector alone, and queries of one id each give their ranks. With fewer than k candidates
    all reached are given; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    def gather(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            for i, x in zip(*_sound(batch), strict=True):
                own = held.setdefault(_key(x), [x, [], False])
                own[1].append(i)
                own[2] |= i % every == 0
                if len(own[1]) > 4 * (k + 1):
                    own[1] = sorted(own[1])[: k + 1]
            if len(held) >= 20_000:
                yield pack(held)
                held = {}
        if held:
            yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array([len(v[0]) for v in held.values()], pa.int32()), pa.array([v[0].tobytes() for v in held.values()], pa.binary()), pa.array([sorted(v[1])[: k + 1] for v in held.values()], pa.list_(pa.int64())), pa.array([v[2] for v in held.values()])],
            ["key", "dims", "vector", "ids", "asks"],
        )

    def asking(batches):
        for batch in batches:
            ids, vectors = _sound(batch)
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in vectors], pa.binary()), pa.array(ids, pa.int64())], ["key", "query_id"])

    parts = rows.mapInArrow(gather, "key binary, dims int, vector binary, ids array<long>, asks boolean")
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    classes = written(parts.groupBy("key").agg(F.first("dims").alias("dims"), F.first("vector").alias("vector"), smallest.alias("ids"), F.max("asks").alias("asks")), "vectors")
    sizes = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max("dims").alias("dims")).first()
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * (sizes["dims"] or 1))))
    shards, blocks = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["q"] // block_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        vectors = np.stack([np.frombuffer(v, np.float64) for v in pdf["vector"]])
        order, layers, tables = build_graph(vectors)
        members = np.full((len(pdf), k + 1), np.iinfo(np.int64).max)
        for r, ids in enumerate(pdf["ids"].iloc[order]):
            members[r, : len(ids)] = ids
        return pd.DataFrame({"dims": [pdf["dims"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "vectors": [vectors[order].tobytes()], "members": [members.tobytes()], "layers": [layers], "links": [[x.tobytes() for x in tables]]})

    shard = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int")
    graphs = classes.select("key", "dims", "vector", "ids", shard.alias("shard")).groupBy("dims", "shard").applyInPandas(build, "dims int, shard int, vectors binary, members binary, layers array<int>, links array<binary>")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dims": [pdf["dims"].iloc[0]], "keys": [b"".join(pdf["key"])], "queries": [b"".join(pdf["vector"])]})

    number = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(blocks)).cast("int")
    packed = classes.where("asks").select("key", "dims", "vector", number.alias("block")).groupBy("dims", "block").applyInPandas(block, "dims int, keys binary, queries binary")
    met = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(graphs, ["dims", "shard"])

    def answer(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                dims = own["dims"].as_py()
                queries = np.frombuffer(own["queries"].as_py(), np.float64).reshape(-1, dims)
                vectors = np.frombuffer(own["vectors"].as_py(), np.float64).reshape(-1, dims)
                members = np.frombuffer(own["members"].as_py(), np.int64).reshape(len(vectors), -1)
                links = [np.frombuffer(x, np.int32).reshape(size, -1) for x, size in zip(own["links"].as_py(), own["layers"].as_py(), strict=True)]
                dist, node = search_graph(queries, vectors, links, beam)
                keys, out_key, out_id, out_score = own["keys"].as_py(), [], [], []
                for i in range(len(queries)):
                    some = np.isfinite(dist[i])
                    d = np.repeat(np.sqrt(dist[i][some]), members.shape[1])
                    ids = members[node[i][some]].ravel()
                    real = ids != np.iinfo(np.int64).max
                    d, ids = d[real], ids[real]
                    best = np.lexsort((ids, d))[: k + 1]
                    out_key += [keys[16 * i : 16 * i + 16]] * len(best)
                    out_id.append(ids[best])
                    out_score.append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_score))], ["key", "vec_id", "score"])

    found = met.select("dims", "keys", "queries", "vectors", "members", "layers", "links").mapInArrow(answer, "key binary, vec_id long, score double")
    best = Window.partitionBy("key").orderBy("score", "vec_id")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(asking, "key binary, query_id long")
    own = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id")))  # the query's row, or one just like it
    joined = queries.join(merged, "key").select("query_id", F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, k).alias("near"))
    return joined.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to each embedding whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
