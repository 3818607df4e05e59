from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join, salted_rank


def test_lookup_join_equals_plain_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"), "id").union(spark.sql("select cast(null as string), -1L"))
    dictionary = rows.filter("id % 5 < 4").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("v")).filter("key is not null")
    want = rows.join(dictionary.drop("n"), "key").select("key", "id", "v")
    for hot in (1, 3, 100):
        got = lookup_join(rows, dictionary, "key", "n", hot)
        assert got.columns == ["key", "id", "v"]
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_salted_rank_leads_each_key_once(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("key"), F.col("id"), (F.col("id") * 7919 % 2003).alias("o"))
    got = salted_rank(rows, "key", [F.col("o"), F.col("id")], "id", 8)
    want = {r["key"]: r["first"] for r in rows.groupBy("key").agg(F.min_by("id", "o").alias("first")).collect()}
    assert {r["key"]: r["id"] for r in got.filter("_rank = 1").collect()} == want
    assert got.count() == 2000
