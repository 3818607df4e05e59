"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that a skew-safe join sends by broadcast, at least; as many as there are shuffle partitions, if these are more.
#: Any key with more than one part in so many of all rows is among them, so no key that stays in the shuffled part has
#: more than a partition's fair share; the broadcast has a row for each, whatever the data's size.
HOT_KEYS = 128
#: Parts into which the rows of one key are dealt for a rank, at least, and likewise.
SALTS = 32


def _at_least(df: DataFrame, least: int) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup_join(rows: DataFrame, dictionary: DataFrame, key: str, count: str, hot: int | None = None) -> DataFrame:
    """Inner join of rows with a dictionary (one row per key) on `key`, safe against hot keys.

    `count` is the dictionary's column with the number of rows of the key. The `hot` most frequent keys are joined
    by broadcast (at most `hot` dictionary rows, whatever the data's size), all others by a shuffled join. Null
    keys match nothing. The result has the columns of rows, then those of the dictionary without key and count.
    Both inputs are read twice: give tables or scans, not long plans.
    """
    top = dictionary.orderBy(F.col(count).desc(), F.col(key)).limit(hot or _at_least(rows, HOT_KEYS))
    value_cols = [c for c in dictionary.columns if c not in (key, count)]
    out = [*rows.columns, *value_cols]
    by_broadcast = rows.join(F.broadcast(top.drop(count)), key).select(*out)
    rest = rows.join(F.broadcast(top.select(key)), key, "left_anti")
    return by_broadcast.unionAll(rest.join(dictionary.drop(count), key).select(*out))


def salted_rank(rows: DataFrame, key: str, order: list[Column], salt_on: str, salts: int | None = None) -> DataFrame:
    """Add `_rank`: 1 for the first row of each key in the given order, else 2 or more.

    Ranked in two steps: within (key, salt), so that no task sorts a whole hot key, then the leaders of the salts,
    at most `salts` of a key, among themselves. Only rank 1 is exact, which is what "keep the first" asks for.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts or _at_least(rows, SALTS))).cast("int"))
    local = salted.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    heat = local.withColumn("_heat", F.when(F.col("_local") == 1, -1).otherwise(F.col("_salt")))
    second = F.row_number().over(Window.partitionBy(key, "_heat").orderBy(*order))
    ranked = heat.withColumn("_second", second)
    return ranked.withColumn("_rank", F.when(F.col("_local") == 1, F.col("_second")).otherwise(F.col("_local"))).drop("_salt", "_local", "_heat", "_second")
