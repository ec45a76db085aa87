"""Shared helpers: reliable lineage cuts and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words as the operators of this package count them.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; where none is set, a local session gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluicegate-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of few rows, so that what a worker holds of long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two bigint columns; nulls and self-loops are ignored.
    Returns ``(node, root)`` for every node that is in some edge and isn't its
    component's smallest node; ``root`` is that smallest node.  Nothing is
    gathered: each round is two grouped minima and two equi-joins, whose hot
    side can be split, and ends in a checkpoint.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = cut(
        pairs.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        # a forest of stars: every child has one parent and no parent is a child
        n, children = pairs.agg(F.count("*"), F.countDistinct("u")).first()
        if n == children and pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
