"""Filling containers of fixed capacity with texts sized in tokens: best-fit decreasing.

Items of one size are interchangeable, so the packing is decided on the histogram of sizes, which has at most
capacity + 1 entries whatever the number of texts, and not on the texts. A segment tree over the possible remaining
capacities finds the tightest open container in logarithmic time. The decision is a short list of runs (the items of
this size with these ranks go to these containers); every item then takes its rank among its size, counted in
parallel, and its container from the run that holds the rank. The result is exactly that of best-fit decreasing
over all items at once.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webwarden.llm.tokens import TOKENIZER_DIR, encode_texts
from webwarden.session import materialize

#: Items of one size that are ranked by one task.
RANK_BLOCK = 20_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: the number of open containers that have each."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, count: int) -> None:
        i = remaining + self.size
        while i:
            self.open[i] += count
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least `need` that an open container has."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, containers) for a histogram size -> number of items, sizes 1..capacity.

    A run (size, first_rank, items, first_container, per_container) says that items first_rank.. of the size go to
    containers first_container.., per_container to each. Placing one item at a time gives the same: once an item of
    size s is in the tightest container with room, that container stays the tightest while it has room for another.
    """
    tree, holes = CapacityTree(capacity), {}
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def opened(remaining: int, first: int, count: int) -> None:
        if count:
            holes.setdefault(remaining, deque()).append((first, count))
            tree.add(remaining, count)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                per = capacity // size
                first, count = containers, -(-left // per)
                containers += count
            else:
                per = room // size
                first, count = holes[room].popleft()
                used = min(count, -(-left // per))
                if used < count:
                    holes[room].appendleft((first + used, count - used))
                tree.add(room, -used)
                count = used
            room = capacity if room is None else room
            placed = min(left, per * count)
            whole, rest = divmod(placed, per)
            runs.append((size, rank, placed, first, per))
            opened(room - per * size, first, whole)
            if rest:
                opened(room - rest * size, first + whole, 1)
            left, rank = left - placed, rank + placed
    return runs, containers


def sized_items(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, piece, start_token, n_tokens): each text once for each container kind of its tokenizer, in
    pieces of the capacity and a rest if it exceeds the capacity, else whole. Empty texts have one piece of 0."""
    cap = F.col("capacity")
    joined = sizes.join(F.broadcast(specs), "tokenizer")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / cap)).cast("int")
    out = joined.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece") * cap
    return out.select("spec_id", "doc_id", "piece", start.cast("bigint").alias("start_token"), F.least(cap.cast("bigint"), F.col("size") - start).alias("n_tokens"))


def pack(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Items with container_id, numbered from 0 for each spec. Items of size 0 are spread over the containers.

    `items` is read three times. Two things come to the driver: the histogram, at most the sum of capacities + 1
    rows, and nothing else; the runs go back by broadcast.
    """
    spark = items.sparkSession
    histogram = items.groupBy("spec_id", "n_tokens").count().collect()
    sizes, rows = {}, []
    for r in histogram:
        sizes.setdefault(r["spec_id"], {})[r["n_tokens"]] = r["count"]
    for spec, hist in sizes.items():
        runs, used = best_fit_plan({s: n for s, n in hist.items() if s}, capacities[spec])
        by_size: dict[int, list] = {}
        for size, *run in runs:
            by_size.setdefault(size, []).append(tuple(run))
        if 0 in hist:
            by_size[0] = [(0, hist[0], 0, 0)]
        rows += [(spec, size, max(1, -(-hist[size] // RANK_BLOCK)), max(1, used), rs) for size, rs in by_size.items()]
    plan = spark.createDataFrame(rows, "spec_id int, n_tokens bigint, blocks int, used bigint, runs array<struct<first_rank:bigint,items:bigint,first:bigint,per:bigint>>")
    blocks = items.join(F.broadcast(plan.select("spec_id", "n_tokens", "blocks")), ["spec_id", "n_tokens"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), "blocks"))
    key = ["spec_id", "n_tokens", "block"]
    counts = blocks.groupBy(*key).count()
    before = counts.select(*key, (F.sum("count").over(Window.partitionBy("spec_id", "n_tokens").orderBy("block")) - F.col("count")).alias("before"))
    local = blocks.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")) - 1)
    ranked = local.join(before, key).withColumn("rank", F.col("before") + F.col("place")).drop("blocks", "block", "before", "place")
    run = F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["items"]))[0]
    placed = ranked.join(F.broadcast(plan.drop("blocks")), ["spec_id", "n_tokens"]).withColumn("run", run)
    container = F.when(F.col("n_tokens") == 0, F.col("rank") % F.col("used")).otherwise(F.col("run.first") + F.expr("(rank - run.first_rank) div run.per"))
    return placed.select("spec_id", container.alias("container_id"), "doc_id", "piece", "start_token", "n_tokens")


def pack_documents(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Every text of `documents`, assigned to containers of every row of `specs` (spec_id, tokenizer, capacity_tokens).

    Null and empty texts are items of size 0; repeated rows are items of their own; empty tables give an empty
    result. Specs with null or non-positive capacity or null tokenizer are left out. Each tokenizer that the specs
    name runs once over the texts.
    """
    spark = documents.sparkSession
    kinds = specs.filter("tokenizer IS NOT NULL AND capacity_tokens > 0").select(F.col("spec_id").cast("int"), "tokenizer", F.col("capacity_tokens").alias("capacity"))
    known = kinds.collect()  # a row for each kind of container, a handful by definition
    sized = None
    for name in sorted({r["tokenizer"] for r in known}):
        one = encode_texts(documents, name, folder=folder, count_only=True).select("doc_id", F.lit(name).alias("tokenizer"), F.col("n_tokens").alias("size"))
        sized = one if sized is None else sized.unionAll(one)
    if sized is None:
        sized = spark.createDataFrame([], "doc_id bigint, tokenizer string, size bigint")
    local = spark.createDataFrame([tuple(r) for r in known], "spec_id int, tokenizer string, capacity int")
    items = sized_items(materialize(sized, "sizes"), local)
    return pack(items, {r["spec_id"]: r["capacity"] for r in known})


def container_fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill): the part of the opened capacity that is used."""
    total = packed.groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return total.join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "spec_id").select(
        "spec_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill")
    )
