"""Vectors: norms, cosine, exact nearest neighbours in blocks, fingerprints of small grey images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webwarden.session import plan_bytes


#: About the size of a block of rows.
BLOCK_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1], rounded; 0 where a norm is zero or the lengths differ."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((n > 0) & (F.size(a) == F.size(b)), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n)), 4)).otherwise(0.0)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the k most similar other rows of each query, ties by id.

    Rows are dealt to blocks by id and each query visits every block, so the work spreads over queries times blocks
    and no task holds more than a block; each block yields its k best, and these are merged. Nothing is left out. There
    are as many blocks as the rows' estimated bytes ask for, and 16 at least.
    """
    blocks = blocks or max(16, plan_bytes(rows) // BLOCK_BYTES)
    r = rows.select(F.col(id_col).alias("id"), normalised(F.col(vector_col)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    q = queries.select(F.col(id_col).alias("query_id"), normalised(F.col(vector_col)).alias("qv")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    pairs = q.join(r, "block").filter("id <> query_id").select("query_id", "block", "id", F.round(dot(F.col("qv"), F.col("v")), 4).alias("similarity"))
    best = [F.col("similarity").desc(), F.col("id")]
    local = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*best))).filter(F.col("rank") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def centroids(rows: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """(label, centroid): the elementwise mean of each label's vectors, combined map-side per label and position."""
    parts = rows.select(F.col(label_col).alias("label"), F.posexplode(vector_col).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def grey_fingerprint(pixels: np.ndarray) -> int:
    """64 bits of an 8 x 9 grey image: bit row * 8 + column is set where a pixel is brighter than the one to its right."""
    a = np.asarray(pixels, float).reshape(8, 9)
    bits = (a[:, :-1] > a[:, 1:]).ravel()
    return int(sum(1 << i for i, b in enumerate(bits) if b))


def shrunk(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the cells of a grid laid over a grey image."""
    a = np.asarray(pixels, float)
    rows, cols = np.array_split(np.arange(a.shape[0]), height), np.array_split(np.arange(a.shape[1]), width)
    return np.array([[a[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for c in cols] for r in rows])


def code_likelihood(pixels: np.ndarray) -> tuple[float, bool]:
    """(confidence, suspect) that a grey image holds a two-dimensional code: dark and light parts of the pixels."""
    a = np.asarray(pixels, float)
    dark, light = float((a < 40).mean()), float((a > 215).mean())
    confidence = round(min(0.95, dark + light), 2) if dark >= 0.12 and light >= 0.20 else 0.0
    return confidence, confidence >= 0.50


def colour_signature(pixels: np.ndarray, top: int = 20) -> list[tuple[tuple[int, ...], tuple[float, float], int]]:
    """(colour, centre, count) of the most frequent colours of an image, components modulo 32, the first seen column by column first."""
    a = np.asarray(pixels)
    flat = (a.swapaxes(0, 1).reshape(-1, a.shape[-1]) % 32).astype(int)
    seen: dict[tuple[int, ...], list[int]] = {}
    for i, c in enumerate(map(tuple, flat.tolist())):
        seen.setdefault(c, []).append(i)
    ranked = sorted(seen.items(), key=lambda kv: -len(kv[1]))[:top]
    return [(c, (float(np.mean([i // a.shape[0] for i in at])), float(np.mean([i % a.shape[0] for i in at]))), len(at)) for c, at in ranked]


def signature_similarity(a: list, b: list, height: int = 100, width: int = 100, top: int = 20) -> tuple[float, bool]:
    """(similarity, is_clone) of two colour signatures of RGBA images of the same size: each colour of the first takes
    the nearest one left of the second, by half the colour and half the centre distance."""
    n = min(len(a), len(b), top)
    if n == 0:
        return 0.0, False
    reach = lambda s: float(np.sqrt((np.array([c for c, _, _ in s], float).max(axis=0) ** 2).sum()))
    apart = lambda k: np.linalg.norm(np.array([x[k] for x in a[:n]], float)[:, None] - np.array([x[k] for x in b[:n]], float)[None], axis=2)
    cost = 0.5 * apart(0) / max(reach(a), reach(b), 1e-6) + 0.5 * apart(1) / np.sqrt(height * width)
    left, total = np.ones(n, bool), 0.0
    for row in cost:
        j = int(np.argmin(np.where(left, row, np.inf)))
        left[j] = False
        total += row[j]
    mean = total / n
    similarity = round(max(0.0, 1.0 - float(mean * 2 if mean > 0.3 else mean / 2 if mean < 0.3 else mean)), 4)
    return similarity, similarity >= 0.955
