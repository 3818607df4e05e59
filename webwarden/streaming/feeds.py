"""Streams: certificate look-alikes, login posts in windows, first deliveries, newest events."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webwarden.functions import logs, network
from webwarden.session import tables_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of parts."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def lookalikes(events: DataFrame, brands: Sequence[str], host: str = "domain") -> DataFrame:
    """Stateless: the events that a look-alike rule keeps, with brand, triggers and level."""
    rated = events.select("*", F.explode(F.array(network.lookalike(F.col(host), brands))).alias("r"))
    return rated.filter("r.keep").select(*events.columns, "r.brand", "r.triggers", "r.level")


def login_windows(lines: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Login posts per address in sliding windows; lines may be late by `late`, after which a window's state goes."""
    posts = logs.login_posts(logs.parse_lines(lines)).withColumn("ts", logs.event_time(F.col("time"))).withWatermark("ts", late)
    return posts.groupBy(F.window("ts", length, slide).alias("w"), "ip").agg(F.count(F.lit(1)).alias("posts"))


def first_deliveries(events: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """The first arrival of each key; a repeat within the watermark is dropped, and state older than it goes."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Process all that a stream has now and give the result as a table in the shared folder. Windows come out once the
    watermark has passed them, and their state goes."""
    spark = stream.sparkSession
    base = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
