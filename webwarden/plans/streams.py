"""Streaming queries, run over what the tables hold; their results equal those of the batch queries, over closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from webwarden.plans import logs as log_plans
from webwarden.plans import network as network_plans
from webwarden.plans.urls import brand_ids
from webwarden.streaming import feeds


def stream_login_windows(spark, sf_dir):
    """The windows that are over: those that end ten minutes before the last login post, or earlier."""
    lines = log_plans.spelt(feeds.table_stream(spark, sf_dir, "events"))
    windows = feeds.login_windows(lines, late="10 minutes")
    return feeds.run_to_end(windows, "logins").select(F.unix_timestamp("w.start").alias("window_start"), "ip", "posts")


def stream_lookalikes(spark, sf_dir):
    events = feeds.table_stream(spark, sf_dir, "certstream_events").select("event_id", "domain")
    return feeds.run_to_end(feeds.lookalikes(events, brand_ids(spark, sf_dir)), "lookalikes").select("event_id", "brand", F.array_join("triggers", ",").alias("triggers"), "level")


QUERIES = {f.__name__: f for f in (stream_login_windows, stream_lookalikes)}
SQL = {"stream_login_windows": log_plans.closed_windows(), "stream_lookalikes": network_plans.SQL["cert_lookalike"]}
