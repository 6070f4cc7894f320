"""Half-open interval sets, one row an interval: set_id, start, end. Empty and reversed intervals count for nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame) -> DataFrame:
    """Touching and overlapping intervals of a set made one."""
    w = Window.partitionBy("set_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where(F.col("start") < F.col("end")).withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    return rows.withColumn("island", F.sum("new").over(w)).groupBy("set_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """(set_id, start, end, in_a, in_b) of the stretches between boundaries of merged sets."""
    def edges(r: DataFrame, name: str) -> DataFrame:
        other = "in_b" if name == "in_a" else "in_a"
        return merged(r).select("set_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select("set_id", "e.at", F.col("e.d").alias(name), F.lit(0).alias(other))

    events = edges(a, "in_a").unionByName(edges(b, "in_b")).groupBy("set_id", "at").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    w = Window.partitionBy("set_id").orderBy("at")
    return events.select("set_id", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("in_a").over(w).alias("in_a"), F.sum("in_b").over(w).alias("in_b"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(a.unionByName(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(_sweep(a, b).where("in_a > 0 and in_b = 0").select("set_id", "start", "end"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(_sweep(a, b).where("in_a > 0 and in_b > 0").select("set_id", "start", "end"))


def covered(ranges: DataFrame) -> DataFrame:
    return merged(ranges).groupBy("set_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def sessions(rows: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """rows with session (from 1): a new one begins where more than gap lies since the row before."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("long")
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
