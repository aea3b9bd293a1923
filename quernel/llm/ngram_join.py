"""N-gram Jaccard join by prefix trees (operator 3).

A document's set holds the hashes of its distinct word n-grams (words as in ``kernel``, of the
lower-cased text); a document of fewer than n words has one n-gram, all its words. Two documents
match if the Jaccard similarity of their sets is ``threshold`` or more. The join is exact, up to
collisions of 48 hash bits within one of P hash ranges.

1. Every n-gram hash goes, packed to six bytes, to its hash range, where the ones held by two or
   more distinct sets are found and numbered by rarity. An n-gram of one set can't add to any
   overlap, so a set keeps only the shared ones, by number, and a set with fewer than
   ``threshold * size`` of them has no partner and is dropped. There are as many ranges as the
   bytes of text ask for, so a task's memory doesn't grow with the table (beyond 3 TB, where
   there are ``MOST_RANGES``, it grows by 20 bytes an n-gram of a range).
2. The numbers order n-grams over the whole corpus, rarest first. Two sets that match share an
   n-gram in their prefixes, so the connected components over prefix n-grams (and sizes that can
   match) hold every match.
3. Each component is stored in a path-compressed trie, commonest n-gram first. Every set is a
   query: it walks down sharing the overlap so far among all sets below, and leaves a subtree
   when the lengths that remain can't reach the overlap needed.
   A large component is cut into blocks of sets that are alike (by the least hash of their
   n-grams). A set goes to its own block, and to another one only if it shares an n-gram of the
   prefixes with a set there that isn't smaller and leaves enough n-grams behind for a match. So
   chance n-grams that connect most sets of a large table don't make all blocks meet. A block
   counts overlaps for a few hundred sets at once, by lists of its n-grams or, for common ones,
   by a matrix product: copies that differ a little have no long paths in common in a trie.
4. A task hands on one row a set (its number of matches and a set that it is connected to), never
   the pairs, which grow with the square of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize, small
from .kernel import mix, ngram_hashes, slices, span_hashes, words

#: Bytes of text a hash range (a task holds some four times as many), and the least and largest number of ranges.
RANGE_BYTES = 48 << 20
LEAST_RANGES = 32
MOST_RANGES = 1 << 16
#: N-grams that a task gathers for a range before it sends them on, and for all ranges.
_A_BLOB = 512
_MOST_HELD = 1 << 23
#: Parts of a range that are sorted one after the other.
_PARTS = 16
#: Sets in a block of a component; components up to this size are searched as a whole.
BLOCK_SETS = 384
#: Sets of other blocks that a task compares with a block; from so many on (as a share of a block) that hold one n-gram, a block is sent as a whole.
_GUESTS = 16_384
_WHOLE = 8
#: Numbers that a step of a task holds at a time, and rows and columns of its matrices.
_AT_ONCE = 1 << 21
_ROWS, _COLUMNS = 256, 2048
#: Edges up to which components are found on the driver (16 bytes each).
DRIVER_EDGES = 1_000_000


def lower(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:  # not UTF-8
        return pc.ascii_lower(column)


def _pack(ranges: int, n: int):
    """Batches (doc_id, text) -> a row (doc_id, fp) a document, one (fp, size) a set, and packed n-grams by hash range.

    Documents are spread by their ids, sets by their fingerprints: copies of one text don't gather in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0
        for batch in batches:
            ids = batch.column(0)
            for a, b, raw, offsets in slices(lower(batch.column(1))):
                starts, ends, first = words(raw, offsets)
                grams, bounds = ngram_hashes(span_hashes(raw, starts, ends), first, n)
                sets = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
                sizes = np.array([len(s) for s in sets], np.int64)
                tokens = np.concatenate(sets)
                cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)])
                at = np.concatenate([[0], np.cumsum(sizes)])
                fps = mix(cum[at[1:]] - cum[at[:-1]] + sizes.astype(np.uint64))
                own = ids.slice(a, b - a)
                spread = (mix(own.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
                yield _packed(spread, own, pa.array(fps.view(np.int64), mask=sizes == 0), None, None)
                fresh = np.zeros(b - a, bool)
                for i in np.flatnonzero(sizes > 0):
                    if (key := int(fps[i])) not in seen:
                        seen.add(key)
                        fresh[i] = True
                if not fresh.any():
                    continue
                home = (fps[fresh] % np.uint64(ranges)).astype(np.int32)
                yield _packed(home, None, fps[fresh].view(np.int64), sizes[fresh], None)
                use = np.repeat(fresh, sizes)
                held.append((tokens[use], np.repeat(fps, sizes)[use]))
                pending += len(held[-1][0])
                if pending >= min(_A_BLOB * ranges, _MOST_HELD):
                    yield blobs(held)
                    held, pending = [], 0
        if held:
            yield blobs(held)

    def blobs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        tokens, fp, part = tokens[order], fp[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        made = [_blob(fp[s:e], tokens[s:e], 6) for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        return _packed(part[cuts].astype(np.int32), None, None, None, pa.array(made, pa.binary()))

    return run


def _packed(part: np.ndarray, doc_id, fp, size, blob) -> pa.RecordBatch:
    made = lambda x, kind: pa.nulls(len(part), kind) if x is None else (x if isinstance(x, pa.Array) else pa.array(x)).cast(kind)
    return pa.RecordBatch.from_arrays([pa.array(part), made(doc_id, pa.int64()), made(fp, pa.int64()), made(size, pa.int64()), made(blob, pa.binary())], ["part", "doc_id", "fp", "size", "blob"])


def _blob(owner: np.ndarray, value: np.ndarray, width: int, sizes: np.ndarray | None = None, tag: int = 0) -> bytes:
    """Numbers of ``width`` bytes by owner (64-bit, in runs), with the owners' sizes if given."""
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.append(edge, len(owner)))
    wide = 1 if counts.max() < 256 else 2 if counts.max() < 65_536 else 4
    head = np.array([len(edge), tag, wide | width << 8 | (sizes is not None) << 16], "<u4").tobytes()
    body = np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return b"".join((head, owner[edge].astype("<u8").tobytes(), b"" if sizes is None else sizes[edge].astype("<u4").tobytes(), counts.astype(f"<u{wide}").tobytes(), body))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, int]:
    """(owners, their counts, numbers, sizes, tag)."""
    m, tag, form = map(int, np.frombuffer(blob, "<u4", 3))
    wide, width, sized = form & 255, form >> 8 & 255, form >> 16
    at = 12 + 8 * m
    owner = np.frombuffer(blob, "<u8", m, 12)
    sizes = np.frombuffer(blob, "<u4", m, at).astype(np.int64) if sized else None
    at += 4 * m * sized
    counts = np.frombuffer(blob, f"<u{wide}", m, at).astype(np.int64)
    raw = np.frombuffer(blob, np.uint8, -1, at + wide * m).reshape(-1, width)
    value = np.zeros((len(raw), 8), np.uint8)
    value[:, :width] = raw
    return owner, counts, value.view("<u8").ravel(), sizes, tag


def _shared(ranges: int):
    """Of one or more hash ranges: passes documents and sets on, and packs each set's n-grams that two sets or more hold, by the set's home range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            plain = batch.filter(pc.is_null(batch.column("blob")))
            if len(plain):
                yield plain
            rest = batch.filter(pc.is_valid(batch.column("blob")))
            for p, blob in zip(rest.column("part").to_pylist(), rest.column("blob").to_pylist(), strict=True):
                blobs.setdefault(p, []).append(blob)
        for p in list(blobs):
            yield from _of_range(p, [_unblob(x)[:3] for x in blobs.pop(p)], ranges)

    return run


def _of_range(p: int, pieces: list[tuple[np.ndarray, ...]], ranges: int) -> Iterator[pa.RecordBatch]:
    fps, counts, token = (np.concatenate([x[k] for x in pieces]) for k in range(3))
    del pieces
    owner = np.repeat(np.arange(len(fps), dtype=np.int32 if len(fps) < 1 << 31 else np.int64), counts)
    part = (token >> np.uint64(44)).astype(np.uint8)
    found = [x for k in range(_PARTS) if (x := _of_part(fps, owner[at := np.flatnonzero(part == k)], token[at], k)) is not None]
    if not found:
        return
    del owner, token, part
    f, value = (np.concatenate(x) for x in zip(*found, strict=True))
    home = f % np.uint64(ranges)
    order = np.lexsort((value, f, home))
    f, value, home = f[order], value[order], home[order]
    cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
    width = (int(value.max()).bit_length() + 7) // 8 or 1
    blobs = [_blob(f[s:e], value[s:e], width, tag=p) for s, e in zip(cuts, [*cuts[1:], len(home)], strict=True)]
    yield _packed(home[cuts].astype(np.int32), None, None, None, pa.array(blobs, pa.binary()))


def _of_part(fps: np.ndarray, owner: np.ndarray, token: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(fingerprint, number) of the n-grams that two sets or more hold; numbers rise with the sets that hold them."""
    ordered = np.sort(token)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if len(twice) == 0:
        return None
    slot = np.minimum(np.searchsorted(twice, token), len(twice) - 1)
    hit = np.flatnonzero(twice[slot] == token)
    f, slot = fps[owner[hit]], slot[hit].astype(np.int64)
    # one entry for each n-gram and distinct set
    order = np.lexsort((slot, f))
    slot, f = slot[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (slot[1:] != slot[:-1])
    slot, f = slot[new], f[new]
    df = np.bincount(slot, minlength=len(twice))
    two = df[slot] >= 2
    slot, f = slot[two], f[two]
    if len(slot) == 0:
        return None
    rank = np.empty(len(twice), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(twice))
    return f, rank[slot] * _PARTS + k


def _assemble(threshold: float):
    """The packed n-grams of a home range -> (fp, size, keys) of the sets that hold enough of them to have a partner; keys rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, list[bytes]] = {}
        known: list[np.ndarray] = []
        for batch in batches:
            sized = batch.filter(pc.is_valid(batch.column("fp")))
            if len(sized):
                known.append(np.stack([sized.column("fp").to_numpy(), sized.column("size").to_numpy()]))
            packed = batch.filter(pc.is_valid(batch.column("blob")))
            for h, blob in zip(packed.column("part").to_pylist(), packed.column("blob").to_pylist(), strict=True):
                homes.setdefault(h, []).append(blob)
        fp_size = np.concatenate(known, axis=1) if known else np.zeros((2, 0), np.int64)
        known_fp, first = np.unique(fp_size[0].view(np.uint64), return_index=True)
        known_size = fp_size[1][first]
        for h in list(homes):
            fps, counts, keys = [], [], []
            for blob in homes.pop(h):
                owners, held, ranks, _, p = _unblob(blob)
                fps.append(owners)
                counts.append(held)
                keys.append(ranks << np.uint64(16) | np.uint64(p))
            fp, count, key = np.concatenate(fps), np.concatenate(counts), np.concatenate(keys)
            every, at = np.unique(fp, return_inverse=True)
            held = np.bincount(at, count)
            whole = known_size[np.searchsorted(known_fp, every)]
            live = held >= threshold * whole - 1e-9
            owner = np.repeat(at, count)
            use = np.flatnonzero(live[owner])
            key, owner = key[use], owner[use]
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
            for s in range(0, len(edge), 256):
                cut = [*edge[s : s + 257], len(owner)][: len(edge[s : s + 256]) + 1]
                o = owner[edge[s : s + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(every[o].view(np.int64)), pa.array(whole[o]), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["fp", "size", "keys"])

    return run


def _prefixes(threshold: float, ranges: int):
    """Batches (fp, size, keys) -> the n-grams of the prefixes, packed by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, left = [], []
            for size, packed in zip(batch.column("size").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                key = np.frombuffer(packed, "<u8")
                left.append(len(key) - math.ceil(threshold * size - 1e-9) + 1)
                tokens.append(key[: left[-1]])
            if not tokens:
                continue
            key = np.concatenate(tokens)
            fp = np.repeat(batch.column("fp").to_numpy().view(np.uint64), left)
            size = np.repeat(batch.column("size").to_numpy(), left)
            part = (mix(key) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, fp, size, part = key[order], fp[order], size[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [_blob(fp[s:e], key[s:e], 7, size[s:e]) for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


class Trie:
    """Sets of ranks in ascending order, path-compressed; a node knows the least set size and the longest rest below it."""

    __slots__ = ("kids", "least", "most", "rest", "seg", "sets")

    def __init__(self, seg: np.ndarray):
        self.seg, self.kids, self.sets, self.least, self.most, self.rest = seg, {}, [], 1 << 60, 0, 0

    def insert(self, ranks: np.ndarray, which: int, size: int) -> None:
        node = self
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.rest = max(node.rest, len(ranks))
            if len(ranks) == 0:
                node.sets.append(which)
                return
            kid = node.kids.get(int(ranks[0]))
            if kid is None:
                kid = node.kids[int(ranks[0])] = Trie(ranks)
                kid.sets.append(which)
                kid.least = kid.most = size
                return
            n = min(len(kid.seg), len(ranks))
            differ = np.flatnonzero(kid.seg[:n] != ranks[:n])
            common = int(differ[0]) if len(differ) else n
            if common < len(kid.seg):
                top = Trie(kid.seg[:common])
                top.least, top.most, top.rest = kid.least, kid.most, kid.rest + len(kid.seg) - common
                kid.seg = kid.seg[common:]
                top.kids[int(kid.seg[0])] = kid
                node.kids[int(ranks[0])] = top
                kid = top
            node, ranks = kid, ranks[common:]

    def search(self, ranks: np.ndarray, size: int, held: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(set, overlap) of all sets that may match; held is 1 at the query's ranks."""
        share = threshold / (1 + threshold)
        found, stack = [], [(kid, 0) for kid in self.kids.values()]
        while stack:
            node, overlap = stack.pop()
            if node.least * threshold > size + 1e-6 or node.most + 1e-6 < size * threshold:
                continue
            need = share * (size + max(node.least, size * threshold)) - 1e-6
            mine = len(ranks) - int(np.searchsorted(ranks, node.seg[0]))
            if overlap + min(mine, len(node.seg) + node.rest) < need:
                continue
            overlap += int(held[node.seg].sum())
            found += [(s, overlap) for s in node.sets]
            if node.kids:
                mine = len(ranks) - int(np.searchsorted(ranks, node.seg[-1], "right"))
                if overlap + min(mine, node.rest) >= need:
                    stack += [(kid, overlap) for kid in node.kids.values()]
        return found


class Block:
    """Sets by the n-grams that they hold, to count the overlaps of many sets at once."""

    def __init__(self, keys: list[np.ndarray]):
        self.n = len(keys)
        owner = np.repeat(np.arange(self.n), [len(k) for k in keys])
        self.every, at = np.unique(np.concatenate(keys), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.sets, self.df = owner[order], np.bincount(at, minlength=len(self.every))
        self.start = np.cumsum(self.df) - self.df

    def _held(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``at``, set) of all sets that hold the n-grams ``at``."""
        counts = self.df[at]
        place = np.repeat(np.arange(len(at)), counts)
        return place, self.sets[np.arange(len(place)) + (self.start[at] - np.cumsum(counts) + counts)[place]]

    def overlaps(self, keys: list[np.ndarray]) -> np.ndarray:
        """For each of ``keys`` the n-grams it shares with each set of the block."""
        token = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        at = np.minimum(np.searchsorted(self.every, token), len(self.every) - 1)
        hit = self.every[at] == token
        at, owner = at[hit], owner[hit]
        out = np.zeros(len(keys) * self.n, np.int64)
        common = (np.bincount(at, minlength=len(self.every)) * self.df > _COLUMNS // 2)[at]
        a, o = at[~common], owner[~common]
        up_to = np.cumsum(self.df[a])
        s = 0
        while s < len(a):
            e = max(s + 1, int(np.searchsorted(up_to, (up_to[s - 1] if s else 0) + _AT_ONCE, "right")))
            place, which = self._held(a[s:e])
            out += np.bincount(o[s:e][place] * self.n + which, minlength=len(out))
            s = e
        out = out.reshape(len(keys), self.n)
        columns, column = np.unique(at[common], return_inverse=True)
        owner = owner[common]
        for s in range(0, len(columns), _COLUMNS):
            own = columns[s : s + _COLUMNS]
            mine, theirs = np.zeros((len(keys), len(own)), np.float32), np.zeros((len(own), self.n), np.float32)
            use = (column >= s) & (column < s + _COLUMNS)
            mine[owner[use], column[use] - s] = 1
            theirs[self._held(own)] = 1
            out += (mine @ theirs).astype(np.int64)
        return out


def _search(threshold: float, pairs: bool):
    """Batches sorted by cell, a block's own sets first -> the matches (fp_a, fp_b, jaccard) of each cell, or (fp, links, root): for sets with a match how many documents match it, and a set that it is connected to. A set may have several rows, whose links add up."""

    def result(fps: np.ndarray, copies: np.ndarray, u: np.ndarray, v: np.ndarray, jaccards: np.ndarray) -> pa.RecordBatch:
        if pairs:
            x, y = fps[u], fps[v]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(jaccards)], ["fp_a", "fp_b", "jaccard"])
        links = np.bincount(u, copies[v], len(fps)) + np.bincount(v, copies[u], len(fps))
        nodes, label = _labels(u, v)
        return pa.RecordBatch.from_arrays([pa.array(fps[nodes]), pa.array(links[nodes].astype(np.int64)), pa.array(fps[label])], ["fp", "links", "root"])

    def component(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """A component that is searched as a whole."""
        keys = [np.frombuffer(k, "<u8") for k in t.column("keys").to_pylist()]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        rank = len(every) - 1 - place  # the commonest first
        sets = [np.sort(x) for x in np.split(rank, np.cumsum([len(k) for k in keys])[:-1])]
        sizes, fps, trie = t.column("size").to_pylist(), t.column("fp").to_pylist(), Trie(np.zeros(0, np.int64))
        for i in range(len(sets)):
            trie.insert(sets[i], i, sizes[i])
        held = np.zeros(len(every), np.int64)
        a, b, jaccards = [], [], []
        for i in range(len(sets)):
            held[sets[i]] = 1
            for j, overlap in trie.search(sets[i], sizes[i], held, threshold):
                if fps[j] < fps[i]:
                    jaccard = overlap / (sizes[i] + sizes[j] - overlap)
                    if jaccard >= threshold:
                        a.append(j)
                        b.append(i)
                        jaccards.append(jaccard)
            held[sets[i]] = 0
        if a:
            yield result(t.column("fp").to_numpy(), t.column("copies").to_numpy(), np.array(a), np.array(b), np.array(jaccards))

    def compare(own: dict[str, np.ndarray], block: Block, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Sets against the larger ones of a block (of those of one size, the ones of a greater fingerprint)."""
        for s in range(0, len(t), _ROWS):
            part = t.slice(s, _ROWS)
            fp, size, copies = (part.column(c).to_numpy() for c in ("fp", "size", "copies"))
            overlap = block.overlaps([np.frombuffer(k, "<u8") for k in part.column("keys").to_pylist()])
            mine = size[:, None]
            later = (own["size"] > mine) | (own["size"] == mine) & (own["fp"] > fp[:, None])
            jaccard = overlap / (mine + own["size"] - overlap)
            q, i = np.nonzero(later & (jaccard >= threshold))
            if len(q):
                yield result(np.concatenate([own["fp"], fp]), np.concatenate([own["copies"], copies]), i, q + block.n, jaccard[q, i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = block = own = None
        kind = "whole"

        def close() -> Iterator[pa.RecordBatch]:
            """What is held: a component, the own sets of a block, or some of its guests."""
            nonlocal block, own
            if not held:
                return
            t = pa.Table.from_batches(held)
            held.clear()
            if kind == "whole":
                yield from component(t)
                return
            if kind == "own":
                own = {c: t.column(c).to_numpy() for c in ("fp", "size", "copies")}
                block = Block([np.frombuffer(k, "<u8") for k in t.column("keys").to_pylist()])
                if t.column("turn")[0].as_py():  # these are compared with one another in the first turn
                    return
            yield from compare(own, block, t)

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("label", "turn", "guest")), strict=True))
            a = 0
            while a < len(cells):
                b = a + 1
                while b < len(cells) and cells[b] == cells[a]:
                    b += 1
                if cells[a] != of or kind == "guest" and sum(map(len, held)) >= _ROWS:
                    yield from close()
                of = cells[a]
                kind = "whole" if of[1] is None else "guest" if of[2] else "own"
                held.append(batch.slice(a, b - a))
                a = b
        yield from close()

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (fp, keys) -> (fp, alike): the least hash of a set's n-grams, which sets have in common as often as they are similar."""
    for batch in batches:
        keys = [int(mix(np.frombuffer(k, "<u8")).min() >> np.uint64(1)) for k in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(keys, pa.int64())], ["fp", "alike"])


def _placed(threshold: float, ranges: int):
    """Batches (fp, size, block, keys) -> the n-grams of the prefixes by hash range, as numbers with their sets, sizes, blocks and the n-grams of the set from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, packed = batch.column("size").to_numpy(), batch.column("keys").to_pylist()
            if not packed:
                continue
            counts = np.array([len(k) // 8 for k in packed])
            used = counts - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            key = np.concatenate([np.frombuffer(k, "<u8")[:n] for k, n in zip(packed, used, strict=True)])
            rest = np.repeat(counts + np.cumsum(used) - used, used) - np.arange(len(key))
            part = (mix(key) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            columns = [(key, "<u8"), *((np.repeat(batch.column(c).to_numpy(), used), k) for c, k in (("fp", "<i8"), ("size", "<u4"), ("block", "<i4"))), (rest, "<u4")]
            blobs = [[v[s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True)] for v in (x[order].astype(k) for x, k in columns)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "key", "fp", "size", "block", "rest"])

    return run


def _guests(threshold: float, whole_from: int):
    """What ``_placed`` gives, of whole n-grams -> (fp, from, block): sets that may match a larger one of another block, or all sets of the block ``from``, where fp is null."""
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if len(b)]
        if not t:
            return
        key, fp, size, block, rest = (np.frombuffer(b"".join(x for b in t for x in b.column(c).to_pylist()), k) for c, k in (("key", "<u8"), ("fp", "<i8"), ("size", "<u4"), ("block", "<i4"), ("rest", "<u4")))
        del t
        order = np.lexsort((block, key))
        key, fp, block, size, rest = key[order], fp[order], block[order], size[order].astype(np.int64), rest[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        count = np.diff(np.append(edge, len(key)))
        # of each n-gram and block: the block, the least and the greatest size, and the most n-grams that are left
        of, low, high, most = block[edge], np.minimum.reduceat(size, edge), np.maximum.reduceat(size, edge), np.maximum.reduceat(rest, edge)
        heads = np.flatnonzero(np.concatenate([[True], key[edge][1:] != key[edge][:-1]]))
        blocks = np.diff(np.append(heads, len(edge)))
        first, blocks = np.repeat(heads, blocks), np.repeat(blocks, blocks)
        # what may be sent: single sets, and whole blocks by a number of their own
        run_of = np.repeat(np.arange(len(edge)), count)
        single = np.flatnonzero((count < whole_from)[run_of] & (blocks > 1)[run_of])
        many = np.flatnonzero((count >= whole_from) & (blocks > 1))
        sender = np.concatenate([run_of[single], many])
        lo, hi, left = (np.concatenate(x) for x in ((size[single], low[many]), (size[single], high[many]), (rest[single], most[many])))
        name = np.concatenate([fp[single], of[many].astype(np.int64)])
        whole = np.arange(len(name)) >= len(single)
        del key, fp, block, size, rest, order, run_of
        up_to = np.cumsum(blocks[sender])
        found: list[np.ndarray] = []
        s = held = 0
        while s < len(sender):
            e = max(s + 1, int(np.searchsorted(up_to, (up_to[s - 1] if s else 0) + _AT_ONCE, "right")))
            n = blocks[sender[s:e]]
            x = np.repeat(np.arange(s, e), n)
            y = np.arange(len(x)) + np.repeat(first[sender[s:e]] - np.cumsum(n) + n, n)
            may = (y != sender[x]) & (lo[x] <= high[y]) & (hi[x] >= threshold * low[y] - 1e-6) & (np.minimum(left[x], most[y]) >= share * (lo[x] + np.maximum(low[y], lo[x])) - 1e-6)
            x, y = x[may], y[may]
            found.append(np.unique(np.rec.fromarrays([whole[x], name[x], of[y]], names="whole,name,block")))
            held += len(found[-1])
            s = e
            if held >= _AT_ONCE or s == len(sender):
                every = np.unique(np.concatenate(found))
                for a in range(0, len(every), 10_000):
                    p = every[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(p["name"], mask=p["whole"]), pa.array(p["name"].astype(np.int32), mask=~p["whole"]), pa.array(p["block"])], ["fp", "from", "block"])
                found, held = [], 0

    return run


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's connected component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for to in (u, v, label[u], label[v]):
            np.minimum.at(new, to, least)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(threshold: float):
    """Packed prefixes of whole n-grams -> edges (a, b) that connect the sets which share one and whose sizes may match, one for each set but the least of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unblob(x) for b in batches for x in b.column("blob").to_pylist()]
        if not got:
            return
        counts = np.concatenate([x[1] for x in got])
        fp = np.repeat(np.concatenate([x[0] for x in got]), counts).view(np.int64)
        size = np.repeat(np.concatenate([x[3] for x in got]), counts)
        key = np.concatenate([x[2] for x in got])
        order = np.lexsort((size, key))
        fp, key, size = fp[order], key[order], size[order]
        near = (key[1:] == key[:-1]) & (size[:-1] >= threshold * size[1:] - 1e-9)
        nodes, label = _labels(fp[1:][near], fp[:-1][near])
        some = nodes != label
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(label[some])], ["a", "b"])

    return run


def components(edges: DataFrame, driver_edges: int | None = None) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): label is the least node of the connected component.

    Up to ``driver_edges`` edges (``DRIVER_EDGES`` if not given) are joined on the driver, and the result is fit to be broadcast;
    beyond, by alternating large and small stars.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    if edges.count() <= (DRIVER_EDGES if driver_edges is None else driver_edges):
        t = edges.toArrow()
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        nodes, label = _labels(a, b)
        return F.broadcast(spark.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(label, pa.int64())})))
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(edges.select(F.col("b"), F.col("b")).distinct())


class _Join:
    """The steps of the join up to the matches between distinct sets."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str):
        self.threshold = threshold
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.ranges = ranges = min(max(LEAST_RANGES, -(-size // RANGE_BYTES)), MOST_RANGES)
        kind = "part int, doc_id long, fp long, size long, blob binary"
        packed = rows.mapInArrow(_pack(ranges, n), kind)
        table = materialize(packed.repartitionById(ranges, F.col("part")).mapInArrow(_shared(ranges), kind))
        homes = table.where("doc_id is null").repartitionById(ranges, F.col("part"))
        self.sets = materialize(homes.mapInArrow(_assemble(threshold), "fp long, size long, keys binary"))
        #: Distinct (doc_id, fp); fp is null for a text without a word.
        self.units = materialize(table.where("doc_id is not null").select("doc_id", "fp").repartition(ranges, "doc_id").distinct())
        #: Each set's documents and the least of them.
        self.held = materialize(self.units.where("fp is not null").groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("name")))

    def matches(self, pairs: bool) -> DataFrame:
        """(fp_a, fp_b, jaccard) of all sets that match, or (fp, links, root) as ``_search`` says."""
        t, ranges, sets = self.threshold, self.ranges, self.sets
        prefixes = sets.mapInArrow(_prefixes(t, ranges), "part int, blob binary")
        label = components(prefixes.repartitionById(ranges, F.col("part")).mapInArrow(_forest(t), "a long, b long"))
        label = materialize(self.held.select("fp", "copies").join(label.withColumnRenamed("node", "fp"), "fp"))
        label = small(label)
        large = materialize(label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_SETS).select("label"))
        rows = sets.join(label, "fp")
        whole = rows.join(small(large), "label", "left_anti").select("label", F.lit(None).cast("int").alias("turn"), F.lit(False).alias("guest"), "fp", "size", "copies", "keys")
        if not large.isEmpty():
            whole = whole.union(self._blocks(rows.join(small(large), "label", "left_semi")))
        rows = whole.repartition(ranges, "label", "turn").sortWithinPartitions("label", "turn", "guest")
        return materialize(rows.mapInArrow(_search(t, pairs), "fp_a long, fp_b long, jaccard double" if pairs else "fp long, links long, root long"))


    def _blocks(self, rows: DataFrame) -> DataFrame:
        """The sets of large components in the cells to be searched: in ``guest`` rows those of other blocks, a part of them in each turn.

        Blocks are told apart by a hash; where two have the same, they are one.
        """
        t, ranges = self.threshold, self.ranges
        like = materialize(rows.select("fp", "keys").mapInArrow(_alike, "fp long, alike long"))
        count = like.groupBy("alike").agg(F.count("*").alias("n")).groupBy((F.col("n") > BLOCK_SETS).alias("many"))
        rest = {r.many: r.n for r in count.agg(F.sum("n").alias("n")).collect()}.get(False, 0)
        many = materialize(like.groupBy("alike").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_SETS))
        # sets that are alike are in blocks of their own if there are enough of them
        own = F.xxhash64("alike", F.pmod("fp", F.ceil(F.col("n") / BLOCK_SETS)))
        mixed = F.xxhash64(F.lit(-1).cast("long"), F.pmod("alike", F.lit(max(1, -(-rest // BLOCK_SETS)))))
        block = materialize(like.join(small(many), "alike", "left").select("fp", F.pmod(F.when(F.col("n").isNull(), mixed).otherwise(own), F.lit((1 << 31) - 1)).cast("int").alias("block")))
        of = small(block)
        placed = rows.select("fp", "size", "keys").join(of, "fp").mapInArrow(_placed(t, ranges), "part int, key binary, fp binary, size binary, block binary, rest binary")
        sent = materialize(placed.repartitionById(ranges, F.col("part")).mapInArrow(_guests(t, max(2, BLOCK_SETS // _WHOLE)), "fp long, from int, block int"))
        whole = sent.where("fp is null").select("from", "block").distinct()
        guests = sent.where("fp is not null").select("fp", "block").union(block.withColumnRenamed("block", "from").join(whole, "from").select("fp", "block"))
        guests = materialize(guests.distinct())
        turns = small(materialize(guests.groupBy("block").agg(F.ceil(F.count("*") / _GUESTS).cast("int").alias("turns"))))
        guests = guests.join(turns, "block").select("fp", F.col("block").cast("long").alias("label"), F.pmod("fp", F.col("turns")).cast("int").alias("turn"), F.lit(True).alias("guest"))
        owners = block.join(turns, "block", "left").select("fp", F.col("block").cast("long").alias("label"), F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)).alias("turn"), F.lit(False).alias("guest"))
        return rows.drop("label").join(small(materialize(owners.union(guests))), "fp").select("label", "turn", "guest", "fp", "size", "copies", "keys")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every document: the least id of its class and how many others match it.

    Two documents match if their sets' Jaccard similarity is ``threshold`` or more. A class holds
    the documents that matches connect. All matches count, those between copies too, but no pair
    is written out, so the rows stay linear in the documents whatever the size of a group.

    Rows with a null id have no result. A null text, an empty one or one without a word matches
    nothing: it is a class of its own with 0 links. Rows that repeat an id and a text count once;
    an id with several texts is one document, in one class, whose links are those of all its
    texts (two of its texts that match count as links, too). Other columns, whatever their names,
    are not read. An empty table gives no rows.
    """
    join = _Join(docs, n, threshold, id_col, text_col)
    found = join.matches(pairs=False)
    # several texts of one document connect its sets
    many = join.units.groupBy("doc_id").agg(F.min("fp").alias("b"), F.count("fp").alias("n")).where("n > 1").select("doc_id", "b")
    versions = join.units.where("fp is not null").join(many, "doc_id").select(F.col("fp").alias("a"), "b")
    label = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(versions)).withColumnRenamed("node", "fp")
    links = small(materialize(found.groupBy("fp").agg(F.sum("links").alias("links"))))
    info = join.held.join(label, "fp", "left").join(links, "fp", "left").where("copies > 1 or label is not null")
    info = materialize(info.select("fp", "name", F.coalesce("label", "fp").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    names = materialize(info.groupBy("class").agg(F.min("name").alias("class_id")))
    info = materialize(info.join(small(names), "class").select("fp", "class_id", "links"))
    every = join.units.join(small(info), "fp", "left")
    return every.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"))


def jaccard_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all documents that match, exact copies in short; nulls and repeats as in ``jaccard_join``.

    Documents of equal sets are named by their least doc_id. There is a row for each pair of
    unequal sets that match, by their names, and one with jaccard 1 for each further document of
    a set; ``all_pairs`` writes them out. Always doc_id_a < doc_id_b, each pair once.
    """
    join = _Join(docs, n, threshold, id_col, text_col)
    a = join.held.select(F.col("fp").alias("fp_a"), F.col("name").alias("a"))
    b = join.held.select(F.col("fp").alias("fp_b"), F.col("name").alias("b"))
    pairs = join.matches(pairs=True).join(a, "fp_a").join(b, "fp_b").where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), "jaccard")
    copies = join.units.join(join.held.where("copies > 1"), "fp").where("doc_id > name").select(F.col("name").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return pairs.union(copies).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def all_pairs(short: DataFrame) -> DataFrame:
    """Every pair of documents that match, from ``jaccard_pairs``' result; quadratic in the copies."""
    copies = short.where("jaccard = 1").select(F.col("doc_id_a").alias("name"), F.col("doc_id_b").alias("doc_id"))
    every = copies.union(copies.select("name", F.col("name").alias("doc_id")).distinct())
    inside = every.alias("x").join(every.alias("y"), "name").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    near = short.where("jaccard < 1")
    for side in ("doc_id_a", "doc_id_b"):
        near = near.join(every.select(F.col("name").alias(side), "doc_id"), side, "left").withColumn(side, F.coalesce("doc_id", side)).drop("doc_id")
    return inside.union(near.select(F.least("doc_id_a", "doc_id_b"), F.greatest("doc_id_a", "doc_id_b"), "jaccard"))


def deduplicate(docs: DataFrame, n: int = 5, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of ``jaccard_join`` the least id stays.

    Columns stay as they are, whatever their names. Rows with a null id or text, or a text without
    a word, stay. Rows that repeat an id are one document and stay or go together. The ids that go
    are broadcast up to ``BROADCAST_ROWS``; only beyond do the texts take part in a shuffle.
    """
    groups = jaccard_join(docs, n, threshold, id_col, text_col)
    gone_id = fresh_name(docs, "gone")
    gone = small(materialize(groups.where("class_id <> doc_id").select(F.col("doc_id").alias(gone_id))))
    return docs.join(gone, docs[id_col].cast("long") == gone[gone_id], "left_anti")
