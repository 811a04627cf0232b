"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, forget, written

WEIGHTS = (1, 2, 3)
CAP = 3
ROWS_PER_BUCKET = 4000
SLOTS_PER_GROUP = 4096


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix", payload: bool = False) -> DataFrame:
    """Take documents of each source until the sources' shares of the total budget meet their weights.

    Size: words of the text (null: 0). Sources in code-point order, null last, get ``weights`` in turn and
    share the budget, which is the sum of all sizes; a target stops at ``cap`` times the source's size and
    the excess is shared again by weight. Each source's documents, shuffled by a digest of their id, pass up
    to ``cap`` times; a pass has the virtual finish time (words of the source so far) / target. All passes
    are ordered by that time and cut where their words would exceed the budget.

    Running sums are taken in two levels, over bounded buckets and within them, so that no source is ever
    in one task. Documents of size 0 keep ``taken`` 0. Repeated rows count each; a null id has a key of its
    own; an empty table gives an empty one. Result: doc_id, size, source_size, target, taken; with
    ``payload`` also the table's own columns (a column with one of the result's names, in any case, is replaced, and one beginning with ``_wfq`` is left out).
    """
    extra = [c for c in docs.columns if payload and c.lower() not in ("doc_id", "size", "source_size", "target", "taken") and not c.lower().startswith("_wfq")]
    base = docs.select(
        "doc_id",
        *extra,
        F.col("source").alias("_wfq_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("_wfq_key"),
    )
    sized = written(base.select("doc_id", "_wfq_source", "size", "_wfq_key"), "mix-sizes")
    if not payload:
        base = sized
    rows = sized.count()
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < rows:
        digits += 1
    bucket = F.substring("_wfq_key", 1, digits).alias("_wfq_bucket")

    parts = sized.groupBy("_wfq_source", bucket).agg(F.sum("size").alias("_wfq_sum"))
    per_source = parts.groupBy("_wfq_source").agg(F.sum("_wfq_sum").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))  # one row for each source
    turn = (F.row_number().over(everything.orderBy(F.col("_wfq_source").asc_nulls_last())) - 1).alias("_wfq_turn")
    shares = per_source.select("*", turn).withColumn("_wfq_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_wfq_turn") % len(weights) + 1).cast("int")).cast("long"))
    by_ratio = everything.orderBy((cap * F.col("source_size")) / F.col("_wfq_weight"), "_wfq_turn")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("_wfq_weight").over(after)
    shares = shares.withColumn("_wfq_capped", level * F.col("_wfq_weight") >= (cap * F.col("source_size")).cast("double"))
    free = F.sum(F.when(~F.col("_wfq_capped"), F.col("_wfq_weight"))).over(everything)
    held = F.coalesce(F.sum(F.when(F.col("_wfq_capped"), cap * F.col("source_size"))).over(everything), F.lit(0))
    rest = (total - held).cast("double") / free
    shares = shares.withColumn("target", F.when(F.col("_wfq_capped"), (cap * F.col("source_size")).cast("double")).otherwise(rest * F.col("_wfq_weight")))

    so_far = Window.partitionBy("_wfq_source").orderBy("_wfq_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_wfq_before", F.coalesce(F.sum("_wfq_sum").over(so_far), F.lit(0)))
    parts = parts.alias("p").join(shares.alias("s"), F.col("p._wfq_source").eqNullSafe(F.col("s._wfq_source"))).select("p._wfq_source", "_wfq_bucket", "_wfq_before", "source_size", "target", "_wfq_turn")
    inside = Window.partitionBy("_wfq_turn", "_wfq_bucket").orderBy("_wfq_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.select("*", bucket).alias("d").join(parts.alias("p"), F.col("d._wfq_source").eqNullSafe(F.col("p._wfq_source")) & (F.col("d._wfq_bucket") == F.col("p._wfq_bucket")))
    placed = placed.select("d.doc_id", *[f"d.`{c}`" for c in extra], "d.size", "d._wfq_key", "d._wfq_bucket", "p._wfq_before", "p.source_size", "p.target", "p._wfq_turn")
    placed = placed.withColumn("_wfq_cum", F.col("_wfq_before") + F.sum("size").over(inside)).drop("_wfq_bucket", "_wfq_before")
    queue = written(placed, "mix-queue")

    finish = lambda turn_no: ((F.lit(turn_no - 1) * F.col("source_size") + F.col("_wfq_cum")).cast("double") / F.col("target"))
    passes = F.explode(F.array(*[F.struct(finish(e).alias("f"), F.lit(e).alias("e")) for e in range(1, cap + 1)]))
    slots = max(64, rows // ROWS_PER_BUCKET)
    slot = F.least(F.floor(F.col("f") * slots), F.lit(4 * slots))
    line = queue.where("size > 0").select("doc_id", "size", "_wfq_turn", "_wfq_key", passes.alias("x")).select("doc_id", "size", "_wfq_turn", "_wfq_key", "x.*").withColumn("slot", slot)
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    forget(docs.sparkSession, sized) if payload else None
    per_slot = written(line.groupBy("slot").agg(F.sum("size").alias("n")), "mix-slots")
    group = F.floor(F.col("slot") / SLOTS_PER_GROUP)

    def crossing(sums: DataFrame, place: str, before: int):
        """The first row of ``sums`` at which the running sum passes the budget, with that sum as ``upto``."""
        up_to = Window.partitionBy(F.lit(0)).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        return sums.withColumn("upto", F.sum("n").over(up_to) + before).where(F.col("upto") > budget).orderBy(place).limit(1).first()

    # in two levels: one row for each group of slots, then the slots of one group
    whole = crossing(per_slot.groupBy(group.alias("slots")).agg(F.sum("n").alias("n")), "slots", 0)
    crossed = whole and crossing(per_slot.where(group == whole["slots"]), "slot", whole["upto"] - whole["n"])
    forget(docs.sparkSession, per_slot)
    order = F.struct("f", "_wfq_turn", "e", "_wfq_key", "doc_id", "size")
    stop = None
    if crossed is not None:
        edge = line.where(F.col("slot") == crossed["slot"]).withColumn("o", order)
        run = F.sum("size").over(Window.partitionBy("slot").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
        stop = edge.withColumn("run", run + (crossed["upto"] - crossed["n"])).where(F.col("run") > budget).orderBy("o").limit(1).select("f", "_wfq_turn", "e", "_wfq_key", "doc_id", "size").first()
    taken = F.lit(0).cast("long")
    for e in range(1, cap + 1):
        here = F.lit(True)
        if stop is not None:
            at = F.struct(finish(e).alias("f"), F.col("_wfq_turn"), F.lit(e).alias("e"), F.col("_wfq_key"), F.col("doc_id"), F.col("size"))
            types = {f.name: f.dataType for f in line.schema.fields}
            end = F.struct(*[F.lit(stop[c]).cast(types[c]).alias(c) for c in ("f", "_wfq_turn", "e", "_wfq_key", "doc_id", "size")])
            here = at < end
        taken = taken + F.when((F.col("size") > 0) & here, F.col("size")).otherwise(0)
    return queue.withColumn("taken", taken).select("doc_id", *extra, "size", "source_size", "target", "taken")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3 in turn."""
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, turn % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY (3 * source_size) / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight >= 3 * source_size AS capped FROM w),
t AS (SELECT *, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
             ELSE CAST(total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS DOUBLE) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM l),
q AS (SELECT d.doc_id, d.size, d.k, t.source_size, t.target, t.turn, t.total,
             sum(d.size) OVER (PARTITION BY t.turn ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, e, CAST((e - 1) * source_size + cum AS DOUBLE) / target AS f FROM q, (VALUES (1), (2), (3)) v(e) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY f, turn, e, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM p),
n AS (SELECT doc_id, k, turn, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= total GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.k = n.k AND q.turn = n.turn
"""
