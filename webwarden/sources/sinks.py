"""Sinks: text and JSON lines, CSV with a verdict, and dispatch of batches to a caller's sender."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webwarden.functions.urls import verdict


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").write.mode("overwrite").text(path)


def write_verdicts(df: DataFrame, path: str) -> None:
    """CSV of scans with their verdict; similarities that are null become 0."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("s_dom", "s_vis") if c in df.columns}
    df.withColumns(zero | {"verdict": verdict(F.col("score"))}).write.mode("overwrite").csv(path, header=True)


def valid_hook(url: Column) -> Column:
    return url.rlike("^https?://[^/]+")


def dispatcher(column: str, send: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each row's text to `send` on the executors, one partition at a time."""

    def deliver(rows: Iterable) -> None:
        for r in rows:
            if r[0] is not None:
                send(r[0])

    return lambda batch, _: batch.select(column).foreachPartition(deliver)
