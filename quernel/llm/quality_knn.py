"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 6).

A bounded sample of labelled documents gives the terms, their weights, the latent space (the top
eigenvectors of the weighted term covariance) and the labelled vectors, all of fixed size, which
are broadcast. Every document is projected and compared with all labelled vectors in blocks of
exact cosine products; its nearest ones vote for each label, weighted by similarity.

Terms are words, their first 4, 5 and 6 bytes (stems), runs of other visible characters, and "a word
in capitals"; each counts as there once, and as there ``OFTEN`` times. A term counts the more the
stronger its presence goes with a label (their phi coefficient), and not at all within chance, so
that rare telling words span directions of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import IS_SPACE, IS_WORD, runs, slices, span_hashes

#: Labelled documents that are sampled; the broadcast holds MAX_LABELLED x DIMENSIONS and MAX_TERMS x DIMENSIONS numbers.
MAX_LABELLED = 4000
MAX_TERMS = 2048
DIMENSIONS = 96
NEIGHBOURS = 15
#: Standard deviations of chance beyond which a term goes with a label.
CHANCE = 6.0
#: Occurrences that count as a term of their own.
OFTEN = 3
LABELS = ("quality", "toxic")
_CAPS = np.uint64(0xC0FFEE)
_STEMS = (4, 5, 6)
_ROWS = 256
_PARTS = 32
_KIND = np.where(IS_SPACE, 0, np.where(IS_WORD, 1, 2)).astype(np.uint8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, their rows from the first) by slices; texts as they are."""
    for a, b, raw, offsets in slices(column):
        low = np.where(_UPPER[raw], raw + np.uint8(32), raw)
        kind = _KIND[raw]
        starts, ends = runs(kind > 0, offsets, kind)
        hashes = span_hashes(low, starts, ends)
        row = np.searchsorted(offsets, starts, "right") - 1
        lengths = ends - starts
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        lower_ = np.concatenate([[0], np.cumsum(_LOWER[raw])])
        caps = (kind[starts] == 1) & (lengths > 1) & (upper[ends] - upper[starts] > 1) & (lower_[ends] == lower_[starts])
        found, rows = [hashes, np.full(int(caps.sum()), _CAPS)], [row, row[caps]]
        for n in _STEMS:
            long = np.flatnonzero((lengths >= n) & (kind[starts] == 1))
            found.append(span_hashes(low, starts[long], starts[long] + n) ^ np.uint64(n))
            rows.append(row[long])
        yield a, b, np.concatenate(found), np.concatenate(rows)


class Space:
    """The fitted terms, latent space and labelled vectors."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        n = max(1, len(texts))
        column = pa.array(texts, pa.large_string())
        term, least, strength = self._telling(column, n, labels)
        best = np.argsort(-strength, kind="stable")[:MAX_TERMS]
        best = np.sort(best)
        term, self.least, self.weight = term[best], least[best], strength[best].astype(np.float32)
        #: The distinct terms, and by column of the space the term's number and its least occurrences.
        self.terms, self.column = np.unique(term, return_inverse=True)
        self.index = np.full(1 << 20, -1, np.int32)
        slot = (self.terms >> np.uint64(44)).astype(np.int64)
        self.clash: dict[int, int] = {}
        for i, s in enumerate(slot.tolist()):
            if self.index[s] < 0:
                self.index[s] = i
            else:
                self.clash[int(self.terms[i])] = i
        # the latent space at every size: the eigenvectors of the largest eigenvalues, as many as there are above rounding
        self.axes = np.zeros((len(best), 0), np.float32)
        if texts and len(best):
            x = np.concatenate([v for _, _, v in self.counts(column)])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            top = np.argsort(-values, kind="stable")[:DIMENSIONS]
            top = top[values[top] > 1e-6 * max(values.max(), 1e-9)]
            self.axes = np.ascontiguousarray(vectors[:, top], dtype=np.float32)
        self.vectors = np.concatenate([v for _, _, v in self.project(column)]) if texts else np.zeros((0, self.axes.shape[1]), np.float32)
        self.prior = self.labels.mean(axis=0) if texts else np.array([1.0, 0.0][: labels.shape[1]], np.float32)

    def _telling(self, column: pa.Array, n: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, least occurrences, strength) beyond chance, by term; a part of all terms at a time, so that memory follows the part."""
        parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(_PARTS)]
        for a, _, hashes, row in terms(column):
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order] + a
            edge = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
            times = np.minimum(np.diff(np.append(edge, len(row))), OFTEN).astype(np.int8)
            hashes, row = hashes[edge], row[edge].astype(np.int32)
            cuts = np.searchsorted(hashes, np.arange(1, _PARTS, dtype=np.uint64) << np.uint64(64 - _PARTS.bit_length() + 1))
            for held, own in zip(parts, zip(*(np.split(x.copy(), cuts) for x in (hashes, row, times)), strict=True), strict=True):
                held.append(own)
        out = []
        for held in parts:
            if not held:
                continue
            hashes, row, times = (np.concatenate(x) for x in zip(*held, strict=True))
            every, at = np.unique(hashes, return_inverse=True)
            pair = at.astype(np.int64) * n + row
            for least in (1, OFTEN):
                strength = self._strength(pair[times >= least], n, len(every), labels)
                some = strength > CHANCE / np.sqrt(n)
                out.append((every[some], np.full(int(some.sum()), least), strength[some]))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        term, least, strength = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((least, term))
        return term[order], least[order], strength[order]

    @staticmethod
    def _strength(pair: np.ndarray, n: int, width: int, labels: np.ndarray) -> np.ndarray:
        """The largest phi coefficient of each term's presence with a label; pairs are term * n + row."""
        at, row = pair // n, pair % n
        df = np.bincount(at, minlength=width).astype(float)
        out = np.zeros(width)
        for k in range(labels.shape[1]):
            yes = np.bincount(at[labels[row, k] > 0.5], minlength=width).astype(float)
            ny = float((labels[:, k] > 0.5).sum())
            if 0 < ny < n:
                out = np.maximum(out, np.abs(yes * n - df * ny) / np.sqrt(np.maximum(df * (n - df) * ny * (n - ny), 1)))
        return out

    def counts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        width = len(self.terms)
        for a, b, hashes, row in terms(column):
            i = self.index[(hashes >> np.uint64(44)).astype(np.int64)]
            some = np.flatnonzero(i >= 0)
            i, h, r = i[some], hashes[some], row[some]
            same = self.terms[i] == h
            if self.clash:
                for j in np.flatnonzero(~same):
                    if (k := self.clash.get(int(h[j]))) is not None:
                        i[j], same[j] = k, True
            i, r = i[same].astype(np.int64), r[same]
            order = np.argsort(r, kind="stable")
            i, r = i[order], r[order]
            for c in range(a, b, _ROWS):  # a wide table for a few rows at a time
                d = min(b, c + _ROWS)
                at = slice(*np.searchsorted(r, (c - a, d - a)))
                x = np.bincount((r[at] - (c - a)) * width + i[at], minlength=(d - c) * width).reshape(d - c, width)
                yield c, d, (x[:, self.column] >= self.least) * self.weight

    def project(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """Unit vectors; 0 where a text has no term of the space."""
        for a, b, x in self.counts(column):
            v = x @ self.axes
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield a, b, np.where(norm > 1e-6, v / np.maximum(norm, 1e-6), 0).astype(np.float32)

    def vote(self, column: pa.Array) -> np.ndarray:
        """The share of each label among the nearest labelled vectors, weighted by similarity; ties by place in the sample."""
        out = np.empty((len(column), self.labels.shape[1]))
        k = min(NEIGHBOURS, len(self.vectors))
        for a, b, v in self.project(column):
            if k == 0:
                out[a:b] = self.prior
                continue
            # equal similarities must be equal numbers, however a block was computed
            cosine = np.round(v @ self.vectors.T, 5)
            least = np.partition(cosine, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k, None]
            near, tied = cosine > least, cosine == least
            near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(axis=1, keepdims=True))
            weight = np.where(near, np.maximum(cosine, 0), 0)
            total = weight.sum(axis=1, keepdims=True)
            out[a:b] = np.where(total > 1e-6, weight @ self.labels / np.maximum(total, 1e-9), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Space:
    """The space of at most ``max_labelled`` labelled documents, those with the least digests of their ids.

    Ids with several label rows take the least quality and the largest toxic label, ids with
    several texts the least text, so each id is one vector; null labels, ids and texts are left
    out. Without labelled documents every vote is (1, 0): all are good.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in LABELS]).dropna()
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and doc_id is not null")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *LABELS).agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.quality, r.toxic) for r in one.toLocalIterator())
    return Space([r[1] for r in got], np.array([r[2:] for r in got], float).reshape(-1, len(LABELS)))


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.5, toxic_cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, quality, toxic, keep) of every row: the votes' shares and whether quality is ``cut`` or more and toxic below ``toxic_cut``.

    A text without a known term, null or empty ones among them, has no neighbours and takes the
    shares of the sample. Each row is judged by itself, so rows that repeat give their results
    again; null ids are kept. Texts are read whole. Neighbours of equal similarity (to five
    places) go by the sample's order, which is that of ids. Other columns, whatever their names,
    are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, max_labelled))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = shared.value.vote(batch.column(1))
            keep = (v[:, 0] >= cut) & (v[:, 1] < toxic_cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v[:, 0]), pa.array(v[:, 1]), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    return rows.mapInArrow(run, "doc_id long, quality double, toxic double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5, toxic_cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, in the same columns, whatever their names, and without a shuffle.

    Rows that repeat stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = shared.value.vote(batch.column(text_col).cast(pa.string()))
            yield batch.filter(pa.array((v[:, 0] >= cut) & (v[:, 1] < toxic_cut)))

    return docs.mapInArrow(run, docs.schema)
