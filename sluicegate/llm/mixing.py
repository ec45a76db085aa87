"""Mixing sources to target weights by weighted fair queueing.

Native: DataFrame functions only.  Each source's documents stand in a shuffled
order (by the MD5 of their id) that may be gone through up to ``max_repeats``
times.  A copy's virtual finish time is the source's cumulative words up to
and with it, divided by the source's target.  The copies are sorted by it over
all sources, and the mix takes them as long as the total budget isn't exceeded.

Cumulative sums are in two levels: totals of small hash buckets, and windows
within a bucket, so that no task holds a source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut

#: Average rows of a bucket of the shuffled order and of a slice of the queue, and the least number of both.
BUCKET_ROWS, BUCKETS, SLICE_ROWS, SLICES = 16_384, 4096, 4096, 65_536
#: Slices for what comes after virtual time 2.
LATE = 1 << 20


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; counts starts after a blank or at the front."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size, weight, target) for (source, source_size), one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share
    the budget (all words by default) by them.  A target stops at
    ``max_repeats`` times its source's size; the excess is shared again until
    none is above.  In closed form: in ascending order of cap over weight, a
    source is capped if its fair share of what those before it left exceeds
    its cap.  The table has one row per source; its windows are over that.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything) if budget is None else F.lit(budget).cast("long")
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("capped", F.col("weight") * F.col("level") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"]
    return ranked.withColumn("fill", level).select(
        "source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("fill")).alias("target")
    )


def _planned(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, digest, nth, source_size, target, times): the finish times of the copies that the mix takes of each row.

    ``nth`` numbers the rows that are equal in id, source, size and text.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))
    rows = cut(rows.withColumn("shuffle", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))))
    n_rows = rows.count()
    buckets = max(BUCKETS, n_rows // BUCKET_ROWS)
    # ascending in the digest, so that buckets are ranges of the shuffled order
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffle", 1, 12), 16, 10).cast("double") / float(1 << 48) * buckets).cast("long"))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = cut(targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0))).alias("b")
    placed = starts.join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("source"), "bucket", "before", "source_size", "target").alias("p")
    order = ["shuffle", "id", "size", "digest"]
    inner = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equal = Window.partitionBy("source", "bucket", *order).orderBy("own")
    summed = rows.withColumn("own", F.sum("size").over(inner)).withColumn("nth", F.row_number().over(equal)).alias("r")
    cum = summed.join(placed, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))).select("r.id", "r.source", "size", "digest", "nth", "shuffle", "source_size", "target", (F.col("before") + F.col("own")).alias("upto"))
    cum = cut(cum)
    # a row with words is told from all others by its source and its cumulative words
    repeats = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("repeat")
    time = (F.col("repeat") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = cum.where("size > 0").select("id", "source", "size", "shuffle", "target", repeats, "source_size", "upto").withColumn("time", time)
    budget = F.lit(per_source.agg(F.sum("source_size")).first()[0] or 0).cast("long")
    # virtual time 1 is where all targets are met; a slice of time is a bucket of the global order
    slices_ = max(SLICES, n_rows // SLICE_ROWS)
    # a source that is much larger than its target has most of its copies beyond 2; they are dealt to a bounded number of slices too
    late = F.least(F.floor((F.col("time") - 2) * 1024), F.lit(LATE))
    slice_ = F.when(F.col("time") < 2, F.floor(F.col("time") * slices_)).otherwise(2 * slices_ + late).cast("long")
    copies = copies.withColumn("slice", slice_)
    per_slice = copies.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    slices = per_slice.withColumn("past", F.coalesce(F.sum("slice_size").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slices = slices.where(F.col("past") < budget).select("slice", "past", (F.col("past") + F.col("slice_size") <= budget).alias("inside"))
    slices = cut(slices)
    whole = copies.join(slices.where("inside").select("slice"), "slice").select("source", "upto", "time")
    edge_rows = copies.join(slices.where("not inside").select("slice", "past"), "slice")
    edge_order = Window.partitionBy("slice").orderBy("time", "shuffle", F.col("source").isNull(), "source", "repeat", "id", "size", "upto").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge_rows.withColumn("upto_all", F.col("past") + F.sum("size").over(edge_order)).where(F.col("upto_all") <= budget).select("source", "upto", "time")
    took = whole.union(edge).groupBy("source", "upto").agg(F.array_sort(F.collect_list("time")).alias("times")).alias("t")
    c = cum.withColumn("key", F.when(F.col("size") > 0, F.col("upto"))).alias("c")
    joined = c.join(took, F.col("c.source").eqNullSafe(F.col("t.source")) & (F.col("c.key") == F.col("t.upto")), "left")
    return joined.select("c.id", "c.source", "c.size", "c.digest", "c.nth", "c.source_size", "c.target", F.coalesce("t.times", F.array().cast("array<double>")).alias("times"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, first_time.

    ``copies`` (0 to ``max_repeats``) is how often the mix takes the document,
    ``taken`` the words of these copies, ``first_time`` the first copy's
    virtual finish time.  Null text: size 0, taken 0 words.  A null id or a
    repeated id sorts by the same rule and is taken like any other row.  Of
    rows that are equal in id, source and text each has a place of its own in
    the order.  Further columns are ignored.
    """
    n = F.size("times").cast("long")
    return _planned(docs, weights, max_repeats, id_col, text_col, source_col).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", n.alias("copies"), F.get("times", F.lit(0)).alias("first_time"), (n * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = True) -> DataFrame:
    """The mixed documents themselves, with all their columns, a row for each copy that ``plan`` takes.

    In ``ordered`` form the rows are range-sorted by the virtual finish time of
    each copy.  A document of no words is in no mix.  Rows that are equal in
    id, source and text are numbered, each takes the copies of its own number.
    """
    planned = cut(_planned(docs, weights, max_repeats, id_col, text_col, source_col).where("size > 0"))
    key = ["_id", "_source", "_size", "_digest"]
    p = planned.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("digest").alias("_digest"), F.col("nth").alias("_nth"), F.col("times").alias("_times"))
    text = F.col(f"row.{text_col}")
    own = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{id_col}").cast("long").alias("_id"), F.col(f"row.{source_col}").alias("_source"), word_count(text).alias("_size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_digest"))

    def same(a, b, cols):
        found = F.lit(True)
        for c in cols:
            found = found & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return found

    def with_times(some, picked, cols):
        return some.alias("o").join(picked.alias("p"), same("o", "p", cols)).select("o.row", "o._id", F.explode("p._times").alias("_time"))

    twice = p.where("_nth = 2").select(*key)
    if twice.isEmpty():
        out = with_times(own, p.where(F.size("_times") > 0), key)
    else:
        mark = twice.withColumn("_more", F.lit(True))
        told = own.alias("o").join(mark.alias("m"), same("o", "m", key), "left").select("o.*", "m._more")
        once = told.where("_more is null").drop("_more").withColumn("_nth", F.lit(1))
        # only rows that come more than once are sorted to be numbered
        several = told.where("_more").drop("_more").withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"))))
        out = with_times(once.union(several), p.where(F.size("_times") > 0), [*key, "_nth"])
    if ordered:
        out = out.repartitionByRange("_time", "_id").sortWithinPartitions("_time", "_id")
    return out.select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM per_source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), encode(source)) AS place FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM placed
), capped AS (
  SELECT *, weight * level >= cap AS is_capped FROM levels
), fill AS (
  SELECT level AS fill FROM capped WHERE NOT is_capped ORDER BY cap / weight, place LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap::DOUBLE ELSE weight * (SELECT fill FROM fill) END AS target FROM capped
), cum AS (
  SELECT s.*, t.source_size, t.target, md5(s.doc_id::VARCHAR) AS shuffle,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT c.*, r.repeat, ((r.repeat * source_size + upto)::BIGINT)::DOUBLE / target AS time
  FROM cum c CROSS JOIN (SELECT unnest(range(0, 3)) AS repeat) r WHERE size > 0
), queued AS (
  SELECT *, sum(size) OVER (ORDER BY time, shuffle, (source IS NULL), source, repeat, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_all FROM copies
), took AS (
  SELECT doc_id, count(*) AS n FROM queued WHERE upto_all <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT c.doc_id, c.size, c.source_size, c.target, (coalesce(t.n, 0) * c.size)::BIGINT AS taken
FROM cum c LEFT JOIN took t ON c.doc_id = t.doc_id
"""
