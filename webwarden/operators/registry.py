"""Dimension upkeep and labelled data: upserts, deletes, unions of sources, balancing, splits, expansion of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `current` replaced by those of `changes` with the same key (trimmed, in lower case), new ones added. Of
    several changes of a key the last by `order` counts; changes without key are left out."""
    k = F.lower(F.trim(F.col(key)))
    new = changes.withColumn(key, k).filter(F.col(key) != "")
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")
    kept = current.join(new.select(F.col(key).alias("_k")), k == F.col("_k"), "left_anti")
    return kept.unionByName(new.select(*current.columns))


def remove(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(F.lower(F.trim(F.col(key))).alias("_k")), F.lower(F.trim(F.col(key))) == F.col("_k"), "left_anti")


def hash_order(*cols: str) -> Column:
    """A pseudo-random but repeatable order of rows, equal on every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def balanced(rows: DataFrame, label: str, key: str, cap: int | None = None) -> DataFrame:
    """As many rows of each label as the rarest has, at most `cap`, chosen by hash order.

    The order is cut by a threshold found per label from counts of hash prefixes, so no task sorts a whole label.
    """
    named = rows.withColumn("_h", hash_order(key)).withColumn("_p", F.substring("_h", 1, 4))
    sizes = named.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label).orderBy("_p")
    before = sizes.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    want = named.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("want")).select(F.least("want", F.lit(cap if cap is not None else 2**62)).alias("want"), F.lit(1).alias("_one"))
    placed = named.join(before, [label, "_p"]).withColumn("_one", F.lit(1)).join(F.broadcast(want), "_one")
    inside = placed.filter(F.col("before") < F.col("want"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", key))
    return inside.withColumn("_r", rank).filter(F.col("_r") <= F.col("want")).select(*rows.columns)


def stratified_split(rows: DataFrame, key: str, part: float) -> DataFrame:
    """Add `is_train`: a hash of the key puts each row on one side, the same at every run and for every label."""
    return rows.withColumn("is_train", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") < int(part * 65536))


def expanded(seeds: DataFrame, url: str, paths: list[str]) -> DataFrame:
    """Distinct URLs of every seed with every path of a short list."""
    return seeds.select(F.explode(F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat(F.rtrim(F.col(url), F.lit("/")), p))).alias(url)).distinct()
