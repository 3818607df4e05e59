"""Encoding of a corpus with a public byte-level BPE tokenizer.

Speculate and verify: for each distinct word, greedy longest match proposes tokens. A sequence of tokens is the
exact encoding if and only if every adjacent pair is, so all adjacent pairs of a batch are tested together against
a sorted table of pairs already judged; a pair that is new is judged once, by merging its bytes exactly. Only words
with an incompatible pair are merged exactly themselves.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the environment or an argument may name another.
TOKENIZER_DIR = os.environ.get("WEBWARDEN_TOKENIZERS", "/opt/tokenizers")
#: Words that a process remembers before it starts afresh: a bound on memory, without effect on results.
WORD_CACHE = 400_000
#: Judged pairs of tokens that a worker remembers, nine bytes each, before it starts afresh.
PAIR_CACHE = 4_000_000
#: Characters of text that are encoded at once.
CHUNK_CHARS = 4_000_000


def load_vocabulary(name: str, folder: str = TOKENIZER_DIR) -> tuple[dict[bytes, int], str]:
    """(ranks, pattern of words) of a vocabulary file of byte-level ranks."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(a): int(b) for a, b in pairs}, module.PATTERN


class SpeculativeEncoder:
    """Exact BPE of one vocabulary; keeps the judged pairs and the words it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        longest: dict[bytes, int] = {}
        for t in ranks:
            longest[t[:2]] = max(longest.get(t[:2], 0), len(t))
        self.longest = longest
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.words: dict[str, list[int]] = {}
        self.known = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.exact_words = self.all_words = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair with the lowest rank first, the leftmost of equals; a heap keeps it
        at n log n for words of any length."""
        n = len(word)
        if n == 1:
            return [self.ranks[word]]
        ranks = self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            mid = end[i]
            if mid >= n or end[mid] != stop or not alive[mid]:
                continue
            alive[mid] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left; single bytes are always tokens."""
        out, i, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while i < n:
            stop = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := ranks.get(word[i:stop])) is None:
                stop -= 1
            out.append(t)
            i = stop
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its own bytes. A token beside itself as 0 is tested alone."""
        keys = (left << 20) | right
        if not len(keys):
            return np.empty(0, bool)
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        new = np.unique(keys if not len(self.known) else keys[self.known[at] != keys])
        if len(self.known) and len(self.known) + len(new) > PAIR_CACHE:
            # Judged pairs are forgotten all at once, and those of this call are judged again, so that none is missing.
            self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
            return self.compatible(left, right)
        if len(new):
            judged = np.fromiter((self.merge(self.bytes_of[k >> 20] + self.bytes_of[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in new.tolist()), bool, len(new))
            place = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, place, new), np.insert(self.fits, place, judged)
            at = np.searchsorted(self.known, keys)
        return self.fits[at]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and remember them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        ok = self.compatible(flat[:-1][inner], flat[1:][inner])
        failing = np.unique(owner[1:][inner][~ok])
        for k in failing.tolist():
            proposals[k] = self.merge(raw[k])
        self.all_words += len(words)
        self.exact_words += len(failing)
        self.words.update(zip(words, proposals))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts in a row, number of tokens of each). Null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > WORD_CACHE:
            self.words = {}
        new = set(chain.from_iterable(split)) - self.words.keys()
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        parts = [np.fromiter(chain.from_iterable(map(get, w)), np.int32) for w in split]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), counts


_ENCODERS: dict[str, SpeculativeEncoder] = {}


def _encoder(shared, name: str) -> SpeculativeEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = SpeculativeEncoder(*shared.value)
    return _ENCODERS[name]


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `limit` characters each, so that very long texts do not pile up."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, count_only: bool = False) -> DataFrame:
    """(doc_id, ids), or (doc_id, n_tokens) with count_only: a row for each row of df, repeated ids included.

    Null and empty texts give the empty list. Strings of special tokens are ordinary text. The vocabulary (50,256
    tokens, below 2 MB) goes to the executors by broadcast; only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer, folder))
    value = pa.field("n_tokens", pa.int64()) if count_only else pa.field("ids", pa.list_(pa.int32()))
    schema = pa.schema([pa.field("doc_id", pa.int64()), value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, counts = encoder.encode_batch(texts[a:b])
                if count_only:
                    column = pa.array(counts, pa.int64())
                else:
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], schema=schema)

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint" if count_only else "doc_id bigint, ids array<int>")
