"""Language-model scores by prediction by partial matching (operator 9).

The model is a trie of byte contexts up to ``ORDER`` bytes, with the counts of the bytes that follow.
A byte is coded in its longest known context; if the byte is new there, an escape is coded (method
C: the number of distinct bytes over that number plus the count) and the next shorter context is
used, in which bytes that the longer one knows are excluded. The code lengths of a document's bytes
add up to its score.

The counts come from all documents. Each text is scored by the counts of the whole corpus less its
own, so it isn't predicted by itself, but by every copy of it that the corpus holds. With ``train``,
the counts are those of all its texts, as they are.

A trie that is larger than ``PASS_ENTRIES`` is cut, in the order of contexts read backwards, into
intervals of at most so many entries; a pass over the texts codes the bytes after the contexts of one
interval. Within a pass the trie is held in sorted arrays, by order. The bytes of a slice of texts
are coded at once: equal (text, context, byte) together, and only those that escape take the steps
to shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .kernel import buffers, slices

ORDER = 4
#: (context, byte) entries of the trie that one pass over the texts broadcasts (48 bytes each in use); larger tries take several passes.
PASS_ENTRIES = 2_000_000
#: Distinct (context, byte) that a task holds before it hands its counts on.
TASK_ENTRIES = 2_000_000
#: Bytes of context whose entries stay together: at most 256 * 256 entries of order 4.
CELL_BYTES = 3
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_NONE = _U((1 << 64) - 1)


def _grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte: the ``order`` bytes before it and itself as one number; 0 bytes stand before a text."""
    key = raw.astype(_U)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    early = np.flatnonzero(place < order)
    for back in range(1, order + 1):
        before = np.zeros(len(raw), _U)
        before[back:] = raw[: max(len(raw) - back, 0)]
        late = early[place[early] < back]
        before[late] = 0
        before <<= _U(8 * back)
        key |= before
    return key


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(key, kind="stable")
    key, count = key[at], count[at]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(count, edge) if len(edge) else count


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, their counts) of an array that may be sorted in place."""
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.diff(np.append(edge, len(key)))


def _count(order: int):
    """Batches (text) -> (gram, n): the distinct grams of a task and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        pending = 0
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column(0)):
                key, n = _runs(_grams(raw, offsets, order))
                keys.append(key)
                counts.append(n)
                pending += len(key)
                if pending > 2 * TASK_ENTRIES:
                    key, n = _merged(keys, counts)
                    if len(key) > TASK_ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["gram", "n"])
                        key, n = key[:0], n[:0]
                    keys, counts, pending = [key], [n], len(key)
        if keys:
            key, n = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a sorted table."""
    if len(table) == 0:
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Piece:
    """The trie of one pass: by order the (context, byte) with their counts, and contexts with their sums."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables: by order, sorted distinct grams and their counts; a context that is there has all its bytes."""
        self.order = len(tables) - 1
        self.grams = [g for g, _ in tables]
        self.counts = [n for _, n in tables]
        self.contexts, self.total, self.kinds, self.excluded = [], [], [], []
        for j in range(self.order + 1):
            ctx, place = np.unique(self.grams[j] >> _U(8), return_inverse=True)
            self.contexts.append(ctx)
            self.total.append(np.bincount(place, self.counts[j], len(ctx)))
            self.kinds.append(np.bincount(place, minlength=len(ctx)).astype(float))
            if j == self.order:
                self.place = place
            if j:  # the counts, in the context that is a byte shorter, of the bytes that this one knows
                low = self.grams[j] & _U((1 << (8 * j)) - 1)
                self.excluded.append(np.bincount(place, self.counts[j - 1][_find(self.grams[j - 1], low)[0]], len(ctx)) if len(ctx) else np.zeros(0))
        self.uniform_kinds = len(self.grams[0])
        # a hash table of the longest contexts' entries
        key = self.grams[self.order]
        self.bits = max(10, int(len(key) * 3).bit_length())
        self.keys, self.at = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            cand = todo[self.keys[slot[todo]] == _NONE]
            self.keys[slot[cand]] = key[cand]
            won = self.keys[slot[todo]] == key[todo]
            self.at[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLIER) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, j: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of grams of order j."""
        if j < self.order:
            return _find(self.grams[j], grams)
        slot = self._slot(grams)
        got = self.keys[slot]
        again = np.flatnonzero((got != grams) & (got != _NONE))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            got[again] = self.keys[slot[again]]
            again = again[(got[again] != grams[again]) & (got[again] != _NONE)]
        return self.at[slot].astype(np.int64), got == grams

    def count(self, j: int, grams: np.ndarray) -> np.ndarray:
        at, there = self.find(j, grams)
        return np.where(there, self.counts[j][at], 0) if len(self.counts[j]) else np.zeros(len(grams), np.int64)


class _Level:
    """The (text, context, byte) of one order in a slice, and the corpus' counts for some of its (text, context), less the text's own."""

    def __init__(self, piece: Piece, j: int, key: np.ndarray, own: bool):
        """key: text number above the gram's 8 * (j + 1) bits, for each byte."""
        self.piece, self.j, self.own = piece, j, own
        self.key, self.n = _runs(key)
        context = self.key >> _U(8)
        self.edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        self.context, self.end = context[self.edge], np.append(self.edge[1:], len(self.key))
        self.mask = _U((1 << (8 * (j + 1))) - 1)

    def entries(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of some groups, for each the place in ``groups``)."""
        size = self.end[groups] - self.edge[groups]
        which = np.repeat(np.arange(len(groups)), size)
        return np.arange(size.sum()) + np.repeat(self.edge[groups] - (np.cumsum(size) - size), size), which

    def open(self, groups: np.ndarray) -> None:
        """Takes the counts of some (text, context), given by their sorted places."""
        p, j = self.piece, self.j
        self.groups = groups
        self.at, self.which = self.entries(groups)
        whole = p.count(j, self.key[self.at] & self.mask)
        mine = self.n[self.at] if self.own else 0
        self.count = whole - mine
        self.gone = (whole > 0) & (self.count == 0)
        self.place, there = _find(p.contexts[j], self.context[groups] & (self.mask >> _U(8)))
        ones = lambda x: np.bincount(self.which, x, len(groups))
        self.total = (np.where(there, p.total[j][self.place], 0) if len(p.total[j]) else np.zeros(len(groups))) - (ones(mine) if self.own else 0)
        self.kinds = (np.where(there, p.kinds[j][self.place], 0) if len(p.kinds[j]) else np.zeros(len(groups))) - ones(self.gone)

    def excluded(self, some: np.ndarray, below: "_Level", down: np.ndarray) -> np.ndarray:
        """The counts in the shorter context (``below``'s opened group ``down``) of the bytes that the opened groups ``some``, which are known, hold."""
        p, j = self.piece, self.j
        out = p.excluded[j - 1][self.place[some]].astype(float)
        if not self.own:
            return out
        # bytes that only the text itself has here
        back = np.full(len(self.groups), -1)
        back[some] = np.arange(len(some))
        lost = np.flatnonzero(self.gone & (back[self.which] >= 0))
        out -= np.bincount(back[self.which[lost]], p.count(j - 1, self.key[self.at[lost]] & (self.mask >> _U(8))), len(some))
        # the text's own bytes there, of those that are left here
        entry, which = below.entries(below.groups[down])
        known = ((self.context[self.groups[some]] & (self.mask >> _U(8)))[which] << _U(8)) | (below.key[entry] & _U(255))
        at, there = _find(self.key, (self.context[self.groups[some]][which] << _U(8)) | (below.key[entry] & _U(255)))
        left = p.count(j, known) - np.where(there, self.n[at], 0) > 0
        return out - np.bincount(which[left], below.n[entry[left]], len(some))


def bits(piece: Piece, raw: np.ndarray, offsets: np.ndarray, mine: np.ndarray | None, own: bool, cell: int) -> np.ndarray:
    """Code length by text of its bytes, or of the marked ones; ``own``: less the text's own counts. Contexts of ``cell`` bytes or more are marked as a whole."""
    order, texts = piece.order, len(offsets) - 1
    grams = _grams(raw, offsets, order)
    text = np.repeat(np.arange(texts).astype(_U), np.diff(offsets))

    def level(j: int) -> _Level:
        key = (text << _U(8 * (j + 1))) | (grams & _U((1 << (8 * (j + 1))) - 1))
        return _Level(piece, j, key if mine is None or j < cell else key[mine], own)

    if mine is not None and not mine.any() or len(raw) == 0:
        return np.zeros(texts)
    top = level(order)
    top.open(np.arange(len(top.edge)))
    cost = np.zeros(len(top.key))
    total, kinds = top.total[top.which], top.kinds[top.which]
    hit, known = top.count > 0, total > 0
    cost[hit] = np.log2((total + kinds)[hit]) - np.log2(top.count[hit])
    missed = known & ~hit
    cost[missed] = np.log2((total + kinds)[missed]) - np.log2(kinds[missed])
    todo, group, tried, above = np.flatnonzero(~hit), top.which[~hit], known[~hit], top
    for j in range(order - 1, -1, -1):
        if len(todo) == 0:
            break
        here = level(j)
        low = ((top.key[todo] >> _U(8 * (order + 1))) << _U(8 * (j + 1))) | (top.key[todo] & here.mask)
        opened, at = np.unique(np.searchsorted(here.context, low >> _U(8)), return_inverse=True)
        here.open(opened)
        entry = np.searchsorted(here.key, low)
        count = piece.count(j, low & here.mask) - (here.n[entry] if own else 0)
        total, kinds = here.total[at], here.kinds[at]
        known, hit = total > 0, count > 0
        # the first context that is known
        start = known & ~tried
        x = start & hit
        cost[todo[x]] += np.log2((total + kinds)[x]) - np.log2(count[x])
        x = start & ~hit
        cost[todo[x]] += np.log2((total + kinds)[x]) - np.log2(kinds[x])
        # after an escape; the exclusion may leave nothing here: then no code is spent
        step = np.flatnonzero(tried)
        if len(step):
            some, back = np.unique(group[step], return_inverse=True)
            down = np.zeros(len(some), np.int64)
            down[back] = at[step]
            excluded = above.excluded(some, here, down)[back]
            fresh = kinds[step] - above.kinds[group[step]]
            left = total[step] - excluded + fresh
            x = (fresh > 0) & hit[step]
            cost[todo[step[x]]] += np.log2(left[x]) - np.log2(count[step[x]])
            x = (fresh > 0) & ~hit[step]
            cost[todo[step[x]]] += np.log2(left[x]) - np.log2(fresh[x])
        rest = ~hit
        todo, group, tried, above = todo[rest], at[rest], known[rest], here
        kinds = kinds[rest]
    if len(todo):
        cost[todo] += np.log2(np.maximum(1, 256 - kinds))
    return np.bincount((top.key >> _U(8 * (order + 1))).astype(np.int64), cost * top.n, texts)


def _backwards(grams: np.ndarray, cell: int) -> np.ndarray:
    """The last ``cell`` bytes of each gram's context, the last one first."""
    out = np.zeros(len(grams), _U)
    for k in range(cell):
        out = (out << _U(8)) | ((grams >> _U(8 * (k + 1))) & _U(255))
    return out


def _cuts(cells: np.ndarray, sizes: np.ndarray, cell: int, most: int) -> list[tuple[int, int]]:
    """Intervals that cover all cells, of at most ``most`` entries each (a cell is never cut)."""
    order = np.argsort(cells)
    bounds, room = [0], most
    for c, n in zip(cells[order].tolist(), sizes[order].tolist(), strict=True):
        if n > room and room < most:
            bounds.append(c)
            room = most
        room -= n
    return list(zip(bounds, [*bounds[1:], 1 << (8 * cell)], strict=True))


def _tables(grams: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int, cell: int, at: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tables of a pass by order: its own entries and their sums, and from ``low`` (order cell - 1, of the whole corpus) the contexts above them."""
    tables = [_merged([grams], [n])]
    for j in range(order - 1, cell - 1, -1):
        tables.append(_merged([tables[-1][0] & _U((1 << (8 * (j + 1))) - 1)], [tables[-1][1]]))
    above = low
    for j in range(cell - 1, -1, -1):
        if j < cell - 1:
            above = _merged([above[0] & _U((1 << (8 * (j + 1))) - 1)], [above[1]])
        place, down = _backwards(above[0], j), _U(8 * (cell - j))
        own = (place >= _U(at[0]) >> down) & (place <= _U(at[1] - 1) >> down)
        tables.append((above[0][own], above[1][own]))
    return tables[::-1]


def code_lengths(docs: DataFrame, train: DataFrame | None = None, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", train_text_col: str = "text", pass_entries: int = PASS_ENTRIES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row: the code length of its text's UTF-8 bytes.

    A null or empty text has 0 bytes, 0 bits and 0 bits a byte. Equal texts get equal scores,
    whatever their ids: each is predicted by the others. Rows that repeat give their results again,
    and null ids are kept. Where nothing is left to predict by (one text alone, or an empty
    ``train``) a byte takes 8 bits. Texts are scored whole. Other columns, whatever their names,
    are not read. An empty table gives no rows.

    Counting shuffles each task's distinct grams once. A pass broadcasts at most ``pass_entries``
    entries (or one cell of contexts, 65,536 at most) besides the shorter contexts above them. One
    pass takes no further shuffle; several read the texts once each and add up code lengths by the
    texts' digests.
    """
    if not 1 <= order <= 4:
        raise ValueError("order must be from 1 to 4")
    spark = docs.sparkSession
    cell = min(CELL_BYTES, order)
    source = (docs.select(F.col(text_col).cast("string").alias("text")) if train is None else train.select(F.col(train_text_col).cast("string").alias("text"))).where("text is not null")
    counts = materialize(source.mapInArrow(_count(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    byte = lambda k: F.shiftright("gram", 8 * (k + 1)).bitwiseAND(F.lit(255))
    where = sum((byte(k) * (1 << (8 * (cell - 1 - k))) for k in range(cell)), F.lit(0)).alias("cell")
    cells = counts.groupBy(where).agg(F.count("*").alias("entries")).toArrow()
    above = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * cell)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    low = _merged([above.column("gram").to_numpy().view(_U)], [above.column("n").to_numpy()])
    passes = _cuts(cells.column("cell").to_numpy(), cells.column("entries").to_numpy(), cell, pass_entries)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    parts = None
    for at in passes:
        several = len(passes) > 1
        held = (counts.where((where >= at[0]) & (where < at[1])) if several else counts).toArrow()
        tables = _tables(held.column("gram").to_numpy().view(_U), held.column("n").to_numpy(), low, order, cell, at)
        shared = spark.sparkContext.broadcast((tables, at if several else None, train is None, cell))
        if not several:
            return rows.mapInArrow(_score(shared), "doc_id long, n_bytes long, bits double, bits_per_byte double")
        part = rows.select(digest, "text").mapInArrow(_partly(shared), "digest string, bits double").groupBy("digest").agg(F.max("bits").alias("bits"))
        part = materialize(part)
        shared.destroy()
        parts = part if parts is None else parts.union(part)
    whole = parts.groupBy("digest").agg(F.sum("bits").alias("bits"))
    sized = rows.select("doc_id", digest, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.join(whole, "digest").select("doc_id", "n_bytes", "bits", (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def _coder(shared):
    """Text columns -> code lengths by row."""
    tables, at, own, cell = shared.value
    piece = Piece(tables)

    def code(column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, b, raw, offsets in slices(column):
            mine = None
            if at is not None:
                place = _backwards(_grams(raw, offsets, piece.order), cell)
                mine = (place >= _U(at[0])) & (place < _U(at[1]))
            out[a:b] = bits(piece, raw, offsets, mine, own, cell)
        return out

    return code


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for batch in batches:
            code = code or _coder(shared)
            cost, n = code(batch.column(1)), np.diff(buffers(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cost), pa.array(cost / np.maximum(n, 1))], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return run


def _partly(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for batch in batches:
            code = code or _coder(shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code(batch.column(1)))], ["digest", "bits"])

    return run
