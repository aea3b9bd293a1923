"""Benchmark decontamination by Wu-Manber search (operator 2).

Texts are lower-cased and cut into words (see ``kernel``) joined by single spaces, with a space
before and after. The test strings are all windows of ``window`` words of the benchmark items, and
items with fewer words as a whole. A block shift table says how far the search may skip at a place,
a bucket by suffix and prefix block selects test strings, and direct comparison confirms. Text is
searched in many lanes at once, so the skips are vectorised.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize, small
from .kernel import IS_WORD, mix, slices
from .ngram_join import lower

_KEEP = IS_WORD.copy()
_KEEP[0] = True
#: Characters of benchmark text that one pass searches for; larger benchmarks take several passes.
PASS_CHARS = 32 << 20
_LANE = 1024
_BITS = 20


def normalize(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all documents, a 0 byte between two, words by single spaces; places of the 0 bytes)."""
    n = len(offsets) - 1
    raw = np.where(raw == 0, 32, raw).astype(np.uint8)
    at = np.repeat(offsets, 3)
    wide = np.insert(raw, at, np.tile(np.array([32, 0, 32], np.uint8), n + 1))
    word = _KEEP[wide]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] = True
    out = np.where(word, wide, 32).astype(np.uint8)[keep]
    return out, np.flatnonzero(out == 0)


class WuManber:
    """All occurrences of byte strings in a byte array."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.shift = np.full(1 << _BITS, self.m - self.block + 1, np.uint16)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._slot(heads, np.full(len(heads), end), rows=True), self.m - end)
        self.buckets: dict[int, list[int]] = defaultdict(list)
        keys = self._key(heads, np.full(len(heads), self.m), rows=True)
        for i, k in enumerate(keys.tolist()):
            self.buckets[k].append(i)
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _block(self, text: np.ndarray, ends: np.ndarray, rows: bool) -> np.ndarray:
        at = ends[:, None] + np.arange(-self.block, 0)
        wide = np.zeros((len(ends), 8), np.uint8)
        wide[:, : self.block] = text[np.arange(len(ends))[:, None], at] if rows else text[at]
        return wide.view(np.uint64).ravel()

    def _slot(self, text: np.ndarray, ends: np.ndarray, rows: bool = False) -> np.ndarray:
        return ((self._block(text, ends, rows) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _key(self, text: np.ndarray, ends: np.ndarray, rows: bool = False) -> np.ndarray:
        prefix = self._block(text, ends - self.m + self.block, rows)
        return mix(self._block(text, ends, rows) * np.uint64(0xD6E8FEB86659FD93) ^ mix(prefix))

    def find(self, text: np.ndarray) -> tuple[list[int], list[int]]:
        """(starts, pattern numbers)."""
        if len(text) < self.m:
            return [], []
        at = np.arange(self.m, len(text) + 1, _LANE)
        stop = np.minimum(at + _LANE, len(text) + 1)
        candidates = []
        while len(at):
            skip = self.shift[self._slot(text, at)]
            hit = at[skip == 0]
            if len(hit):
                candidates.append(hit)
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not candidates:
            return [], []
        ends = np.sort(np.concatenate(candidates))
        keys = self._key(text, ends)
        some = self.known[(keys >> np.uint64(64 - _BITS)).astype(np.int64)]
        starts, which = [], []
        for end, key in zip(ends[some].tolist(), keys[some].tolist(), strict=True):
            for i in self.buckets.get(key, ()):
                p = self.patterns[i]
                if text[end - self.m : end - self.m + len(p)].tobytes() == p:
                    starts.append(end - self.m)
                    which.append(i)
        return starts, which


def test_strings(items: list[tuple[int, str]], window: int) -> dict[bytes, list[int]]:
    """The items that hold each test string; items without a word or text have none."""
    held: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        column = lower(pa.array([text or ""]))
        out, _ = normalize(*next((raw, off) for _, _, raw, off in slices(column)))
        found = out.tobytes().replace(b"\0", b"").split()
        for i in range(max(1, len(found) - window + 1) if found else 0):
            held[b" " + b" ".join(found[i : i + window]) + b" "].add(item)
    return {k: sorted(v) for k, v in held.items()}


def _finder(strings: dict[bytes, list[int]]):
    """Texts -> (row, item, hits) in arrays; short strings have an automaton of their own, so that they don't shorten all shifts."""
    groups = [g for g in ([p for p in strings if len(p) >= 24], [p for p in strings if len(p) < 24]) if g]
    searches = [WuManber(sorted(g)) for g in groups]

    def find(column: pa.Array) -> Counter:
        hits: Counter = Counter()
        for a, _, raw, offsets in slices(lower(column)):
            text, zeros = normalize(raw, offsets)
            for search in searches:
                starts, which = search.find(text)
                rows = np.searchsorted(zeros, starts, "right") - 1 + a
                for row, i in zip(rows.tolist(), which, strict=True):
                    for item in strings[search.patterns[i]]:
                        hits[row, item] += 1
        return hits

    return find


def _passes(benchmark: DataFrame, window: int, item_col: str, text_col: str, chars: int) -> Iterator[tuple[dict[bytes, list[int]], bool]]:
    """(test strings, whether there are several passes); all texts of an item are in one pass, so that none of its windows counts twice."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and item_id is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = 1 + total // chars
    for k in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        yield test_strings([(r.item_id, r.text) for r in part.toLocalIterator()], window), passes > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, n_windows): how many places of a document hold a test string of a benchmark item; rows only where there is one.

    One pass over the texts, without a shuffle, for each ``pass_chars`` characters of benchmark, and
    one pass's test strings on the executors at a time. Items are spread over passes by a hash and
    never cut, so a pass may hold an item more than its share. The number of passes doesn't change
    the result.

    Each row of ``docs`` is judged by itself, so a row that repeats gives its results again, and
    null ids are kept. Null and empty texts have no hits, nor have null or empty items or items with
    a null id. Rows that repeat an item_id are one item with the windows of all its texts; a window
    that it holds twice counts once. Texts are searched whole. Other columns, whatever their names,
    are not read. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for strings, several in _passes(benchmark, window, item_col, "text", pass_chars):
        shared = docs.sparkSession.sparkContext.broadcast(strings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _finder(shared.value) if shared.value else None
            for batch in batches:
                if find and (hits := find(batch.column(1))):
                    at = sorted(hits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in at])), pa.array([i for _, i in at], pa.int64()), pa.array([hits[x] for x in at], pa.int64())], ["doc_id", "item_id", "n_windows"])

        found = rows.mapInArrow(run, "doc_id long, item_id long, n_windows long")
        if several:
            found = materialize(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, text_col: str = "text", item_col: str = "item_id", pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text there is no test string of ``benchmark``, in the same columns, whatever their names.

    Null and empty texts stay. Rows are judged one by one, so rows that repeat stay or go together.
    In one pass there is no shuffle. Several passes, as in ``contaminated``, give the digests of
    the texts to drop, which are broadcast up to ``BROADCAST_ROWS``; texts are never rewritten.
    """
    digests = None
    for strings, several in _passes(benchmark, window, item_col, "text", pass_chars):
        shared = docs.sparkSession.sparkContext.broadcast(strings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=docs.columns.index(text_col) if not several else 0) -> Iterator[pa.RecordBatch]:
            find = _finder(shared.value) if shared.value else None
            for batch in batches:
                hit = np.zeros(len(batch), bool)
                if find:
                    hit[[r for r, _ in find(batch.column(at).cast(pa.string()))]] = True
                yield batch.filter(pa.array(hit if several else ~hit))

        if not several:
            return docs.mapInArrow(run, docs.schema)
        texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
        found = materialize(texts.mapInArrow(run, "text string").select(F.md5(F.col("text").cast("binary")).alias("digest")).distinct())
        shared.destroy()
        digests = found if digests is None else digests.union(found)
    name = fresh_name(docs, "digest")
    gone = small(materialize(digests.distinct().withColumnRenamed("digest", name)))
    return docs.join(gone, F.md5(docs[text_col].cast("string").cast("binary")) == gone[name], "left_anti")
