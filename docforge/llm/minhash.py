"""Near-duplicates by SuperMinHash, banding, exact verification and union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import components, documents, forget, holding, release, written
from .kernel import U

WIDTH = 5
#: Signature slots and the slots of a band: a pair at 0.75 misses all 32 bands with probability 2e-4, at 0.8 with 3e-6.
SLOTS, ROWS = 160, 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Elements signed at a time; members of a block of a cluster; bytes of sets compared in a task; columns of a product.
ELEMENTS, BLOCK, BIN_BYTES, COLUMNS = 1 << 15, 384, 8 << 20, 4096


def super_minhash(values: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (one row a set) of sets of 64-bit values given back to back.

    Element e draws a random permutation and uniform r_j; its value at slot p_j is j + r_j, and a slot
    keeps the least. All elements take step j together. A set stops at the first j below which all its slots are
    filled, as later steps only bring larger values. Values are (j << 56) | 56 random bits.
    """
    sets = len(first) - 1
    out = np.full(sets * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    sizes = np.diff(first)
    at = 0
    while at < sets:
        to = at + 1
        while to < sets and first[to + 1] - first[at] <= ELEMENTS:
            to += 1
        values_here = values[first[at] : first[to]]
        own = np.repeat(np.arange(at, to), sizes[at:to])
        perm = None
        for j in range(slots):
            if not len(values_here):
                break
            draw = kernel.mix(values_here + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = (j + ((kernel.mix(draw ^ U(0xD6E8FEB86659FD93)) >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)).astype(np.int64)
            if j == 0:
                slot, first_k = k, k
            else:
                rows = np.arange(len(values_here))
                if perm is None:
                    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(values_here), 1))
                    perm[rows, first_k] = 0
                slot = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
            np.minimum.at(out, own * slots + slot, U(j) << U(56) | draw >> U(8))
            full = (out[at * slots : to * slots].reshape(to - at, slots) != U(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            alive = ~full[own - at]
            if not alive.all():
                values_here, own = values_here[alive], own[alive]
                if perm is None:
                    first_k = first_k[alive]
                else:
                    perm = perm[alive]
        at = to
    return out.reshape(sets, slots)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    hashes, first = kernel.words(data, offsets)
    return kernel.distinct(*kernel.shingles(hashes, first, width))


def sketch(docs: DataFrame, slots: int = SLOTS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys of its bands (only where a task meets a set first)."""
    bands = slots // rows

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            n = batch.num_rows
            counts, digests, keys = np.zeros(n, np.int64), [None] * n, [None] * n
            for row, data, offsets in kernel.slices(batch.column(1)):
                values, first = shingle_sets(data, offsets, width)
                new, parts = [], []
                for r in range(len(offsets) - 1):
                    own = values[first[r] : first[r + 1]]
                    counts[row + r] = len(own)
                    if len(own):
                        digests[row + r] = d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        if d not in seen:
                            seen.add(d)
                            new.append(row + r)
                            parts.append(own)
                if new:
                    signature = super_minhash(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), slots)
                    band = np.zeros((len(new), bands), np.uint64)
                    for i in range(rows):
                        band = kernel.mix(band * U(3) + signature[:, i :: rows][:, :bands])
                    band = kernel.mix(band + np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).astype(np.int64)
                    for r, own in zip(new, band, strict=True):
                        keys[r] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first set of its group of links, from exact intersections of all of them, and how many it has.

    Only columns (shingles) that two sets hold matter; they are counted by products of 0/1 matrices of
    bounded width.
    """
    g = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(g), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    both = np.zeros((g, g), np.float64)
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((g, min(COLUMNS, width - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    left, right = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    root = np.arange(g)
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        root[max(i, j)] = min(i, j)
    for i in range(g):
        root[i] = root[root[i]]
    return root, np.bincount(left, minlength=g) + np.bincount(right, minlength=g)


def confirmed(clusters: DataFrame, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the members (id, component) of each cluster, enough of them to join all that are linked.

    Sets are compared where they are: no pair is sent anywhere. A small cluster is compared within one task. One of
    more than ``block`` members is compared in blocks, each set sent once; of each group so found the member with the most
    links stands for it in the next level, until these fit a block. Members still outside their
    cluster's largest group are then compared with all others of the cluster, block by block, so no link that could join
    two groups is missed, while a group of many copies costs as much as it has members.
    """
    spark = docs.sparkSession
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    parts = clusters.join(sizes, "component").select(F.col("id").alias("member"), "component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    parts = written(parts, "members")
    texts = holding(docs.select(F.col("doc_id").cast("long").alias("member"), "text"), "member", parts.select("member"))
    texts = texts.join(parts, "member").select("member", "component", "blocks", "text")

    def sets(batches):
        for batch in batches:
            out = []
            for _, data, offsets in kernel.slices(batch.column(3)):
                values, first = shingle_sets(data, offsets, width)
                out += [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["member", "component", "blocks", "body"])

    made = written(texts.mapInArrow(sets, "member long, component long, blocks int, body binary"), "sets")
    total = made.where("blocks = 1").agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("b")).first()["b"]
    bins = max(1, -(-total // BIN_BYTES))

    def compare(table: pa.Table) -> pa.Table:
        """Links of each cluster in the task; for a large one also (h, h, component) of each group's best linked member."""
        table = table.sort_by([("component", "ascending"), ("member", "ascending")])
        members, groups, many = table["member"].to_numpy(), table["component"].to_numpy(), table["blocks"].to_numpy() > 1
        edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
        none = np.zeros(0, np.int64)
        a, b, of = [none], [none], [none]
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            root, degree = np.zeros(1, np.int64), np.zeros(1, np.int64)
            if high - low > 1:
                root, degree = linked([np.frombuffer(x.as_py(), np.uint64) for x in table["body"][low:high]], percent)
                joined = np.flatnonzero(root != np.arange(high - low))
                a.append(members[low + joined])
                b.append(members[low + root[joined]])
                of.append(np.full(len(joined), -1))
            if many[low]:
                order = np.lexsort((-degree, root))
                hubs = order[np.flatnonzero(np.concatenate([[True], np.diff(root[order]) > 0]))]
                a.append(members[low + hubs])
                b.append(members[low + hubs])
                of.append(groups[low : low + 1].repeat(len(hubs)))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "of": np.concatenate(of)})

    shape = "a long, b long, of long"
    block_of = lambda n: F.pmod(F.xxhash64("member", F.lit(n)), F.col("blocks")).cast("int")
    alone = F.col("blocks") == 1
    level = made.select("member", "component", "blocks", "body", F.when(alone, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("bin"), F.when(alone, -1).otherwise(block_of(0)).alias("low"))
    found = written(level.groupBy("bin", "low").applyInArrow(compare, shape), "found")
    links = found.where("a <> b").select("a", "b")
    before, depth = None, 0
    while True:
        hubs = found.where("a = b").select(F.col("a").alias("member"), F.col("of").alias("component"))
        counts = hubs.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if size["most"] < 2 or before is not None and 2 * size["n"] > before:
            break
        before, depth = size["n"], depth + 1
        hubs = hubs.join(counts.select("component", F.ceil(F.col("n") / block).cast("int").alias("hub_blocks")), "component").select("member", "hub_blocks")
        level = holding(made.select("member", "component", "body"), "member", hubs.select("member")).join(hubs, "member")
        level = level.withColumn("low", F.pmod(F.xxhash64("member", F.lit(depth)), F.col("hub_blocks")).cast("int")).withColumn("blocks", F.lit(2))
        found = written(level.select("member", "component", "blocks", "body", "low").groupBy("component", "low").applyInArrow(compare, shape), "found")
        links = links.unionByName(found.where("a <> b").select("a", "b"))
    if before is None:
        return links
    links = written(links, "links")
    large = parts.where("blocks > 1")
    grouped = large.join(components(links).select(F.col("id").alias("member"), F.col("component").alias("label")), "member", "left").select("member", "component", "blocks", F.coalesce("label", "member").alias("label"))
    grouped = written(grouped, "groups")
    counts = grouped.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("component").agg(F.max(F.struct("n", (-F.col("label")).alias("label"))).alias("top"), F.sum("n").alias("all"))
    main = main.select("component", (-F.col("top.label")).alias("main"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("others")).where("others > 0")
    open_ = written(grouped.join(main, "component").select("member", (F.col("label") == F.col("main")).alias("settled"), "others"), "open")
    rows = holding(made, "member", open_.select("member")).join(open_, "member")
    # a settled member meets every block of the others; one of these meets every block of settled and of other members
    rows = rows.withColumn("own", F.when(F.col("settled"), block_of(0)).otherwise(F.pmod(F.xxhash64("member", F.lit(-1)), F.col("others")).cast("int")))
    settled = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("own").alias("low"), j.cast("int").alias("high")))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(j.cast("int").alias("low"), F.col("own").alias("high"))),
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct((-1 - F.least("own", j)).cast("int").alias("low"), F.greatest("own", j).cast("int").alias("high"))),
    )
    met = rows.select("member", "component", F.lit(1).alias("blocks"), "body", F.explode(F.when(F.col("settled"), settled).otherwise(outside)).alias("x"))
    rest = met.select("member", "component", "blocks", "body", "x.low", "x.high").groupBy("component", "low", "high").applyInArrow(compare, shape)
    links = written(links.unionByName(rest.select("a", "b")), "links")
    forget(spark, made)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, slots: int = SLOTS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Documents with equal sets form one class, whose smallest id stands for it. Classes that share a band's
    bucket are candidates; a bucket sends each member once, tied to its smallest, and the ties join candidates into
    clusters. Within a cluster links are found on full sets until none could join two groups, so no group is split.

    Null and empty texts, and texts of white space, have no shingles and are their own component; a null id
    is linked with nothing (component_id null, kept true). Equal ids are one document. No rows give none.
    """
    base = docs.select("doc_id", "text")
    sketches = written(sketch(base, slots, rows, width), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands", ignorenulls=True).alias("bands")), "classes")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    ties = buckets.join(shared, "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    links = written(confirmed(components(written(ties, "ties")), base, percent, width, block), "links")
    labels = components(links)
    release(docs.sparkSession)
    members = some.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
    members = members.join(labels, members["rep"] == labels["id"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    # equal ids with different texts are one node: it takes the smallest component
    named = members.groupBy("doc_id").agg(F.min("component").alias("component")).withColumnRenamed("doc_id", "named_id")
    out = sketches.join(named, sketches["doc_id"] == named["named_id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped at a similarity of 0.75 of five-word shingles."""
    return near_duplicates(documents(spark, sf_dir))


#: Every pair that shares a shingle, counted, and all that is reached over the links.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS met FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.met = l.a),
c AS (SELECT doc_id, min(met) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
