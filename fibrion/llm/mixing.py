"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document is a packet of its source's flow; its size is its number of words. A flow is served in shuffled order (by
MD5 of seed, doc_id and text), as often as its target needs, at most `MOST` times round, and each turn of a document is a
packet of its own. A packet's virtual finish time is the words its flow has sent when it is through, divided by the flow's
target. The packets of all sources are range-sorted by it, a running total of words goes over the sorted ranges, and the
queue is truncated where the total budget is spent. What lies too near the cut for whole packets to tell is sorted again
word by word, each word with a virtual finish time of its own, so the cut falls between two words and every source's
words come within one of its target.

Running totals never sit in one task: an order is cut into ranges, ranges are summed first, and the running total inside
a range starts from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Hex digits of the shuffle key that make a bucket: 16**3 buckets a source.
DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: shares of the whole by weight, none above `most` times its source's size.

    The excess of capped sources is shared again by weight; sources reach their cap in order of size over weight, so
    those capped are the first k of that order for the first k at which the next one stays below its cap. `rank` is a source's
    place by code point, null last. One narrow row a source goes through one task, so sources may be many (a million take
    some ten MB), but not as many as documents.
    """
    order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", choice.cast("double")).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("left_words", (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double"))
    rows = rows.withColumn("left_weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("rate", F.col("left_words") / F.col("left_weight")).withColumn("place", F.row_number().over(by_ratio))
    open_ = most * F.col("source_size") > F.col("w") * F.col("rate")  # right up to the first such place
    rows = rows.withColumn("first", F.min(F.when(open_, F.struct("place", "rate"))).over(everything))
    below = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(below, (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("first.rate"))
    return rows.select("source", "rank", "source_size", target.alias("target"))


def _running(rows: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """`rows` with `name`, the running total of `size` over all rows in `order` (which must tell all rows apart): range-sorted, ranges summed first."""
    n = common.partitions(rows.sparkSession)
    dealt = common.cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum(size).alias("_words"))
    before = F.sum("_words").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.sum(size).over(inside)).drop("_part", "_before")


def _queue(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, source, size, key) -> the same with rank, source_size, target and end (words of the source's shuffled
    documents up to this one); and (rank, source_size, target, largest) of the sources."""
    rows = common.cut(rows.withColumn("bucket", F.substring("key", 1, DIGITS)))
    buckets = common.cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("size").alias("largest")))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"), F.max("largest").alias("largest"))
    same = F.col("t.source").eqNullSafe(F.col("z.source"))
    sources = targets(sizes.select("source", "source_size"), weights, most).alias("t").join(sizes.alias("z"), same)
    sources = common.cut(sources.select("t.source", "t.rank", "t.source_size", "t.target", "z.largest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    starts = starts.select("b.source", "b.bucket", "base", "rank", "source_size", "target")
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))
    queue = rows.alias("r").join(starts.alias("s"), on).select("r.row", "r.doc_id", "r.bucket", "r.key", "r.size", "s.base", "s.rank", "s.source_size", "s.target")
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = queue.withColumn("end", F.col("base") + F.sum("size").over(inside))
    return common.cut(queue.drop("bucket", "key", "base")), sources


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, row: str | None = None) -> DataFrame:
    """One row per row of (doc_id, text, source): row, doc_id, size, source_size, target, taken, finish (virtual time at
    which the document is first through; null where nothing is taken).

    Null text: size 0. Null source: a source of its own, last. Documents of no words take nothing. Null and repeated
    doc_ids are mixed row by row (rows that share doc_id and text follow each other). `row` names a column that tells rows
    apart, if there is one. Other columns are left out.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    own = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(own.alias("row"), F.col("doc_id").cast("long"), "source", common.n_words(F.col("text")).alias("size"), key.alias("key"))
    queue, sources = _queue(rows, weights, most)
    total = sources.agg(F.sum("source_size").alias("budget"), F.sum("largest").alias("service")).first()
    budget, service = total["budget"] or 0, total["service"] or 0  # service: no more words can be in packets half sent

    turns = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")).cast("int") + 1)
    packets = queue.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    packets = packets.withColumn("begin", F.col("end") - F.col("size") + F.col("turn") * F.col("source_size"))
    packets = packets.select("row", "rank", "target", "size", "begin", ((F.col("begin") + F.col("size")) / F.col("target")).alias("finish"))
    line = common.cut(_running(packets, ["finish", "rank"], "size", "total"))
    edge = line.agg(F.max(F.when(F.col("total") <= budget - service, F.col("total"))).alias("whole"), F.min(F.when(F.col("total") > budget, F.col("finish"))).alias("high")).first()
    whole, high = edge["whole"] or 0, edge["high"]

    near = line.where(F.col("total") > budget - service)
    last = F.col("begin") + F.col("size")
    if high is not None:  # the words of this packet and those before it are more than the budget
        near = near.where(F.col("begin") / F.col("target") < high)
        last = F.least(last, F.floor(F.lit(high) * F.col("target")).cast("long") + 1)
    words = near.select("row", "rank", "target", F.explode(F.sequence(F.col("begin") + 1, last)).alias("word"))
    words = words.select("row", "rank", (F.col("word") / F.col("target")).alias("finish"), F.lit(1).cast("long").alias("one"))
    sent = _running(words, ["finish", "rank"], "one", "place").where(F.col("place") <= budget - whole).groupBy("row").agg(F.count("*").alias("words"))
    through = line.where(F.col("total") <= budget - service).groupBy("row").agg(F.sum("size").alias("words"))
    taken = sent.unionByName(through).groupBy("row").agg(F.sum("words").alias("taken"))
    out = queue.join(taken, "row", "left")
    finish = F.when(F.col("taken") > 0, F.col("end") / F.col("target"))
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), finish.alias("finish"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The queue of single words, all of them: each source's word k has finish time k / target, and the first words of that
#: order that make up the budget are sent.
OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s
), r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - 3 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM r
), f AS (
  SELECT min(place) AS first FROM l WHERE 3 * source_size > w * rate
), t AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CASE WHEN first IS NULL OR place < first THEN CAST(3 * source_size AS DOUBLE) ELSE w * (SELECT rate FROM l WHERE place = first) END AS target
  FROM l, f
), n AS (
  SELECT rank, row_number() OVER (ORDER BY k / target, rank) AS place FROM (SELECT rank, target, unnest(range(1, 3 * source_size + 1)) AS k FROM t)
), g AS (
  SELECT rank, count(*) AS goal FROM n WHERE place <= (SELECT sum(source_size) FROM t) GROUP BY rank
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(g.goal, 0) AS goal,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (rank)
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) + greatest(0, least(size, goal - start - 2 * source_size)) AS BIGINT) AS taken
FROM q
"""
