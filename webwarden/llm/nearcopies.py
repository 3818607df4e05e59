"""Near-duplicate pages with small edits: all pairs above a Jaccard threshold, and their groups.

A page is a bit vector over the word sequences of its visible words. Generalised pigeonhole: its set bits are split
into groups of correlated bits, namely the sequences that share their anchor word, which an edit changes together.
If B is similar to A, at most k bits of A are missing in B; give each group i a threshold T_i of -1, 0, 1, ... such
that the sum of T_i + 1 is k + w, probe T_i + 1 bits of each group, and at least w probes of A must hit B. A dynamic
program gives the thresholds per page, unequal over the groups, to make the estimated number of candidates least;
the estimates come from counters over all pages. Whatever they say, the bound holds, so no pair is lost. Bits that many
pages have are spread over tasks. Candidates
with enough hits are verified on the exact sets. Exact copies are one page throughout.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join
from webwarden.session import materialize

#: Of the query over pages: least similarity, words of a sequence, least words of a page.
SIMILARITY, SEQUENCE, LEAST_WORDS = 0.6, 3, 60
#: Counters of the frequency estimates, a fixed 16 MB that is sent by broadcast; two sequences may share a counter.
COUNTER_BITS = 22
#: Pages with one bit, or copies of one page, that one task of a join gets; those of a more frequent one are spread.
HOT = 4096
#: Copies whose ids are sent by broadcast, 8 MB at most; more are taken out by a shuffled join.
BROADCAST_IDS = 1_000_000
#: The part of the bits by which probes exceed what the bound needs, so that candidates need several hits.
SPARE_PROBES = 0.03
#: How much a further probe of one group adds to its estimate: correlated bits find mostly the same pages.
GROUP_OVERLAP = 0.5


_COMMENT = re.compile(r"(?s)<!--.*?-->")
_DROPPED = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Word hashes that a process remembers before it starts afresh.
_HASH_CACHE = 500_000
# Odd multipliers that mix the hashes of a sequence's words by their place.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def _replaced(pattern: re.Pattern, by: str, text: str, closer: str) -> str:
    """pattern.sub, tried only as far as the last closer: what is opened after it never matches, and trying it at
    every opening would take time in the square of a long text."""
    end = text.rfind(closer) + len(closer)
    return pattern.sub(by, text[:end]) + text[end:] if end >= len(closer) else text


def page_words(markup: str) -> list[str]:
    """The words of a page, in lower case: runs of letters and digits once comments, script and style elements are
    dropped and every other tag is replaced by a space."""
    text = _replaced(_DROPPED, "", _replaced(_COMMENT, "", markup, "-->"), ">")
    return list(map(str.lower, _WORD.findall(_replaced(_TAG, " ", text, ">"))))


class WordHashes(dict):
    """64-bit hash of each word, kept for the next time."""

    def __missing__(self, word: str) -> int:
        if len(self) > _HASH_CACHE:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def sequence_bits(words: list[str], hashes: WordHashes, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, anchors) of the distinct word sequences, sorted: each sequence's 64-bit hash, and the place in the page's
    order of anchors of its own, the least hash of its words, which the sequences around one word share."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - sequence + 1
    mixed = np.zeros(n, np.uint64)
    anchor = h[:n].copy()
    for j in range(sequence):
        part = h[j : j + n] * np.uint64(_MIX[j % len(_MIX)])
        mixed ^= part ^ (part >> np.uint64(29))
        mixed *= np.uint64(_MIX[-1])
        np.minimum(anchor, h[j : j + n], out=anchor)
    bits, first = np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64), return_index=True)
    return bits, np.unique(anchor[first], return_inverse=True)[1].astype(np.int32)


_SETS = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("bits", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int32())), ("content", pa.binary())])


def sequence_sets(df: DataFrame, id_col: str, markup_col: str, sequence: int = SEQUENCE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, size, bits, anchors, content) of the rows with at least `least_words` words: the distinct sequences as
    hashes with their anchors, and a digest of the whole set. Whole texts, one pass in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, kept, bits, anchors, digests = b.column(0).to_pylist(), [], [], [], []
            for rid, markup in zip(ids, b.column(1).to_pylist()):
                words = page_words(markup)
                if len(words) >= max(least_words, sequence):
                    own, anchor = sequence_bits(words, hashes, sequence)
                    kept.append(rid), bits.append(own), anchors.append(anchor), digests.append(md5(own.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(map(len, bits), pa.int32()), _lists(bits), _lists(anchors, np.int32), pa.array(digests, pa.binary())], schema=_SETS)

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{markup_col}`").alias("m")).filter(F.length("m") > 0)
    return source.mapInArrow(run, "id bigint, size int, bits array<bigint>, anchors array<int>, content binary")


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))


def required_overlap(size_a: int, size_b: int, similarity: float) -> int:
    """The least number of common bits of two sets with at least this Jaccard similarity."""
    return math.ceil(similarity / (1 + similarity) * (size_a + size_b) - 1e-9)


def probe_budget(size: int, similarity: float) -> tuple[int, int]:
    """(k, w) of a page: k bits may be missing in a similar page that is at least as large, and w hits are asked."""
    k = size - required_overlap(size, size, similarity)
    return k, max(1, min(size - k, int(SPARE_PROBES * size)))


def allocate(pages: list[list[np.ndarray]], units: list[int]) -> list[list[int]]:
    """For each page, T_i + 1 of each group such that they sum to the page's units and the cost is least.

    pages[p][i][u - 1] estimates the candidates when u bits of group i are probed. One dynamic program over the groups
    runs for all pages together: its row g, u is a whole-array step.
    """
    most, deep = max(units), max(map(len, pages))
    wide = max(len(c) for costs in pages for c in costs)
    table = np.full((deep, wide, len(pages), 1), np.inf)
    for p, costs in enumerate(pages):
        for g, c in enumerate(costs):
            table[g, : len(c), p, 0] = c
    best = np.full((len(pages), most + 1), np.inf)
    best[:, 0] = 0.0
    choices = np.zeros((deep, len(pages), most + 1), np.int16)
    for g in range(deep):
        after, chosen = best.copy(), choices[g]
        for u in range(1, min(wide, most) + 1):
            cost = table[g, u - 1]
            if not np.isfinite(cost).any():
                break
            tried = best[:, :-u] + cost
            better = tried < after[:, u:]
            after[:, u:][better] = tried[better]
            chosen[:, u:][better] = u
        best = after
    out = []
    for p, costs in enumerate(pages):
        taken, left = [0] * len(costs), units[p]
        for g in range(len(costs) - 1, -1, -1):
            taken[g] = int(choices[g, p, left])
            left -= taken[g]
        out.append(taken)
    return out


#: Pages whose thresholds are found together; and the bits times units of one program. A larger page is dealt into
#: blocks of at most that size, each with its part of the units and a program of its own, so that memory and time grow
#: with the page and not with its square. The sum over the blocks is the page's, so the bound holds as before.
TOGETHER, PROGRAM_CELLS = 128, 400_000


def program_blocks(groups: list[np.ndarray], costs: list[np.ndarray], units: int) -> list[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """[(units, groups, costs)]: the programs of one page, one block unless bits times units exceed PROGRAM_CELLS.

    Groups are dealt out in turn, and so are the bits of a group that is larger than a block's part, such as the lone
    bits, which are sorted by cost: every block gets alike groups, and equal parts of the units are near the best.
    """
    bits = sum(map(len, groups))
    blocks = math.ceil(math.sqrt(bits * units / PROGRAM_CELLS))
    if blocks <= 1:
        return [(units, groups, costs)]
    dealt: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []) for _ in range(blocks)]
    for g, (group, cost) in enumerate(zip(groups, costs)):
        if len(group) * blocks <= bits:
            dealt[g % blocks][0].append(group)
            dealt[g % blocks][1].append(cost)
            continue
        # A part keeps each bit's addition to the whole group's estimate.
        steps = np.diff(cost, prepend=0.0)
        for k in range(min(blocks, len(group))):
            dealt[k][0].append(group[k::blocks])
            dealt[k][1].append(np.cumsum(steps[k::blocks]))
    ends = np.concatenate([[0], np.cumsum([sum(map(len, d[0])) for d in dealt])]) * units // bits
    return [(int(y - x), *d) for x, y, d in zip(ends, ends[1:], dealt) if y > x]


def grouped_costs(anchors: np.ndarray, others: np.ndarray, units: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(groups, costs) of the bits that other pages may have: their places by anchor, cheapest first. All groups of
    one bit are offered as one, since of them the cheapest are always best. A bit that adds more to its group than
    the dearest of the `units` cheapest costs by itself is in no best choice, and is left out."""
    at = np.flatnonzero(others > 0)
    if len(at) > units:
        own = others[at]
        at = at[own <= np.partition(own, units - 1)[units - 1] / GROUP_OVERLAP]
    order = at[np.lexsort((others[at], anchors[at]))]
    named = anchors[order]
    starts = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    lone = order[starts[sizes == 1]]
    lone = lone[np.argsort(others[lone], kind="stable")]
    groups = [lone] if len(lone) else []
    costs = [np.cumsum(others[lone]).astype(float)] if len(lone) else []
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        g = order[a : a + n]
        c = others[g].astype(float)
        groups.append(g)
        costs.append(c + GROUP_OVERLAP * (np.cumsum(c) - c))
    return groups, costs


def chosen_probes(pages: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[np.ndarray]:
    """The places of the bits to probe of each page, from (anchors, others). `others` estimates how many other pages
    have each bit; bits that certainly no other page has fill units at no cost and are not sent anywhere."""
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(pages)
    waiting = []
    for p, (anchors, others) in enumerate(pages):
        k, w = probe_budget(len(others), similarity)
        units = k + w - int((others == 0).sum())
        if units <= 0:
            continue
        waiting += [(u, p, g, c) for u, g, c in program_blocks(*grouped_costs(anchors, others, units), units)]
    waiting.sort(key=lambda x: (x[0], len(x[2])))
    for at in range(0, len(waiting), TOGETHER):
        part = waiting[at : at + TOGETHER]
        # The lone bits' curve is long: it is cut to the units that a page can spend.
        taken = allocate([[c[:units] for c in costs] for units, _, _, costs in part], [x[0] for x in part])
        for (_, p, groups, _), t in zip(part, taken):
            found[p] = np.concatenate([found[p], *[g[:u] for g, u in zip(groups, t)]])
    return found


def frequency_counters(sets: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """How many pages have a bit that falls on each of 2**bits counters: an upper estimate of the frequency of each
    bit. The array has a fixed size, so it may be collected and sent out."""
    slot = F.col("bit").bitwiseAND((1 << bits) - 1).cast("int")
    counted = sets.select(F.explode("bits").alias("bit")).groupBy(slot.alias("slot")).agg(F.least(F.count(F.lit(1)), F.lit(2**32 - 1)).alias("n"))
    table = counted.toArrow()
    counters = np.zeros(1 << bits, np.uint32)
    counters[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return counters


_ROW = pa.schema([("bit", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("salts", pa.int32())])
_ROW_DDL = "bit bigint, id bigint, size int, salts int"


def _bit_rows(batches: Iterator[pa.RecordBatch], counters: np.ndarray, hot: int, choose) -> Iterator[pa.RecordBatch]:
    """(bit, id, size, salts) of the bits that choose(bits, sizes, batch) marks, batch by batch. salts says over how
    many tasks the pages with the bit are spread: one for all but hot bits."""
    mask = len(counters) - 1
    for b in batches:
        ids, sizes = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
        bits = b.column(1).flatten().to_numpy()
        kept = choose(bits, sizes, b)
        owner, own = np.repeat(np.arange(len(ids)), sizes)[kept], bits[kept]
        salts = 1 + counters[own & mask] // np.uint32(hot)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(salts.astype(np.int32))], schema=_ROW)


def probe_rows(sets: DataFrame, shared, similarity: float) -> DataFrame:
    """(bit, id, size, salts) of the bits of each page that are probed; `shared` is the broadcast counters."""

    def choose(bits: np.ndarray, sizes: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        counters = shared.value
        anchors, others = batch.column(2).flatten().to_numpy(), counters[bits & (len(counters) - 1)].astype(np.int64) - 1
        probed = np.zeros(len(bits), bool)
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        pages = [(anchors[x:y], others[x:y]) for x, y in zip(ends, ends[1:])]
        for at, places in zip(ends, chosen_probes(pages, similarity)):
            probed[at + places] = True
        return probed

    hot = HOT
    return sets.select("id", "bits", "anchors").mapInArrow(lambda batches: _bit_rows(batches, shared.value, hot, choose), _ROW_DDL)


def probed_rows(sets: DataFrame, probes: DataFrame, shared, bits: int = COUNTER_BITS) -> DataFrame:
    """(bit, id, size, salts) of the bits of each page that fall on a counter of some probe. The marks of the counters
    have a fixed size, 2**bits bytes, so they may be collected and sent out; a bit that shares a probe's counter is
    only carried in vain."""
    mask = (1 << bits) - 1
    slots = probes.select(F.col("bit").bitwiseAND(mask).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    marks = np.zeros(1 << bits, bool)
    marks[slots] = True
    marked, hot = sets.sparkSession.sparkContext.broadcast(marks), HOT
    return sets.select("id", "bits").mapInArrow(lambda batches: _bit_rows(batches, shared.value, hot, lambda own, sizes, batch: marked.value[own & mask]), _ROW_DDL)


def _salt(row: str, salts: str = "salts"):
    return F.pmod(F.xxhash64(row), F.col(salts)).cast("int")


def _spread_bit():
    """The key under which a bit is joined: itself, or for a further salt a hash of both. Should a hash equal another
    bit, a candidate more is verified."""
    return F.when(F.col("salt") == 0, F.col("bit")).otherwise(F.xxhash64("bit", "salt")).alias("key")


def _replicated(df: DataFrame, salts: str = "salts") -> DataFrame:
    """Each row once for every salt of its key, to meet rows of that key on whichever salt they have."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1)))


def similar_representatives(sets: DataFrame, similarity: float) -> DataFrame:
    """(id_a, id_b, similarity) of every pair of distinct sets, id_a < id_b. `sets` has one row per distinct set."""
    shared = sets.sparkSession.sparkContext.broadcast(frequency_counters(sets))
    probes = materialize(probe_rows(sets, shared, similarity), "probes")
    p = _replicated(probes).select(_spread_bit(), F.col("id").alias("p_id"), F.col("size").alias("p_size"))
    x = probed_rows(sets, probes, shared).withColumn("salt", _salt("id")).select(_spread_bit(), F.col("id").alias("x_id"), F.col("size").alias("x_size"))
    larger = (F.col("x_size") > F.col("p_size")) | ((F.col("x_size") == F.col("p_size")) & (F.col("x_id") > F.col("p_id")))
    near = F.col("x_size") * F.lit(similarity) <= F.col("p_size") + F.lit(1e-6)
    hits = p.join(x, "key").filter(larger & near).groupBy("p_id", "x_id", "p_size", "x_size").agg(F.count(F.lit(1)).alias("hits"))
    part = similarity / (1 + similarity)
    need = F.ceil(F.lit(part) * (F.col("p_size") + F.col("x_size")) - 1e-9)
    least = F.ceil(F.lit(part) * (F.col("p_size") * 2) - 1e-9)
    spare = F.greatest(F.lit(1), F.least(least, F.floor(F.lit(SPARE_PROBES) * F.col("p_size")).cast("bigint")))
    candidates = materialize(hits.filter(F.col("hits") >= spare + need - least).select(F.least("p_id", "x_id").alias("id_a"), F.greatest("p_id", "x_id").alias("id_b")), "candidates")
    ids = candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    wanted = materialize(sets.select("id", "bits").join(ids, "id", "left_semi"), "wanted")
    a = wanted.select(F.col("id").alias("id_a"), F.col("bits").alias("bits_a"))
    b = wanted.select(F.col("id").alias("id_b"), F.col("bits").alias("bits_b"))
    common = F.size(F.array_intersect("bits_a", "bits_b"))
    verified = candidates.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", common.alias("common"), F.size("bits_a").alias("na"), F.size("bits_b").alias("nb"))
    value = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return verified.select("id_a", "id_b", value.alias("similarity")).filter(F.col("similarity") >= F.lit(similarity) - 1e-12)


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep, copies): every page with the least id of its exact copies and their number, found by the digest of
    the set."""
    reps = materialize(sets.groupBy("content").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("uses"), F.count(F.lit(1)).alias("copies")), "reps")
    return lookup_join(sets.select("id", "content"), reps, "content", "uses").select("id", "rep", "copies")


class NearCopies:
    """The similarity join of one table: classes of exact copies, and the similar pairs of their representatives."""

    def __init__(self, df: DataFrame, id_col: str, markup_col: str, similarity: float = SIMILARITY, sequence: int = SEQUENCE, least_words: int = LEAST_WORDS):
        """Null markup and pages below `least_words` take no part; an empty table gives empty results."""
        sets = materialize(sequence_sets(df, id_col, markup_col, sequence, least_words), "sets")
        self.members = materialize(classes(sets), "classes")
        copies = self.members.filter("id <> rep").select("id")
        if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            distinct = sets.join(F.broadcast(copies), "id", "left_anti")
        else:
            distinct = materialize(sets.join(copies, "id", "left_anti"), "distinct")
        self.links = materialize(similar_representatives(distinct.select("id", "bits", "anchors"), similarity), "links")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every similar pair of rows, exact copies included. The copies of a page of which
        there are many are spread over tasks."""
        m = self.members.withColumn("salts", (F.floor(F.col("copies") / HOT) + 1).cast("int"))
        spread = m.withColumn("salt", _salt("id"))
        reps = m.filter("id = rep").select("rep", "salts")
        across = self.links.select("id_a", "id_b")
        for end, out in (("id_a", "x"), ("id_b", "y")):
            keyed = _replicated(across.withColumnRenamed(end, "rep").join(reps, "rep")).drop("salts")
            across = keyed.join(spread.select("rep", "salt", F.col("id").alias(out)), ["rep", "salt"]).drop("rep", "salt")
        same = m.filter("copies > 1")
        inside = spread.filter("copies > 1").select("rep", "salt", F.col("id").alias("x")).join(_replicated(same).select("rep", "salt", F.col("id").alias("y")), ["rep", "salt"]).filter("x < y").select("x", "y")
        return across.select("x", "y").unionAll(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, rep, links, group_id): one row per page with its class, the number of similar classes, and the least
        id of the connected group it belongs to."""
        links = self.links.select("id_a", "id_b")
        degree = links.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        labels = connected(links)
        per_rep = self.members.select("rep").distinct().join(degree, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        return self.members.join(per_rep, "rep").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "rep").alias("group_id"))


def connected(links: DataFrame) -> DataFrame:
    """(id, group_id) of every id in a link: the least id of its connected component.

    Alternates large-star and small-star steps, which halve the distances to the least id, until nothing changes.
    Each round is written to the shared folder; only one number comes to the driver.
    """
    edges = materialize(links.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialize(small, "edges")
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
