"""Language identification as inference of a multilingual mixture (operator 10).

Each language has a model of its words' n-grams of bytes, fitted on a bounded sample of labelled
rows. The words of a document are drawn from a mixture of languages: expectation-maximisation
estimates the proportions from the words' n-gram likelihoods, to convergence. The language set grows
by one language at a time, the likeliest first, as long as one of them raises the likelihood by more
than a penalty (half the logarithm of the number of words, plus ``PENALTY`` for each word) and each
language of the set keeps a share of ``LEAST_SHARE`` or ``LEAST_WORDS`` words, whichever is less.

All documents of a slice are inferred at once: a word is a row of log-likelihoods by language, and
expectation and maximisation are sums by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import mix, slices, words
from .ngram_join import lower

#: Labelled rows per language that the models are fitted on.
ROWS_A_LANGUAGE = 400
#: Bytes in an n-gram.
ORDER = 4
#: Expectation-maximisation ends for a document when no share changes by more, or after so many steps.
TOLERANCE = 1e-4
ITERATIONS = 200
#: Least share of a language in the set, in texts of up to LEAST_WORDS / LEAST_SHARE words.
LEAST_SHARE = 0.1
#: In longer ones so many words are enough, whatever the text's length.
LEAST_WORDS = 10
#: Nats a word that a further language must bring, besides half the logarithm of the number of words.
PENALTY = 0.02
UNKNOWN = "und"
_BITS = 18
_SMOOTH = 0.05


def word_grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash slot of the n-gram that ends at each byte of each word or at the space after it, first slot of each word, first word of each document).

    A word has a space before and after it; an n-gram doesn't go beyond them.
    """
    starts, ends, first = words(raw, offsets)
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    total = int((size + 1).sum())
    at = np.arange(total) + np.repeat(starts - begin, size + 1)
    inside = np.arange(total) - np.repeat(begin, size + 1)
    last = inside == np.repeat(size, size + 1)
    text = np.where(last, np.uint8(32), raw[np.minimum(at, max(len(raw) - 1, 0))]) if total else np.zeros(0, np.uint8)
    key = text.astype(np.uint32)
    for back in range(1, ORDER):
        before = np.zeros(total, np.uint32)
        before[back:] = text[: total - back]
        before = np.where(inside >= back, before, np.uint32(32) if back == 1 else np.uint32(0))
        if back > 1:
            before[inside == back - 1] = 32
        key |= before << np.uint32(8 * back)
    slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    return slot.astype(np.int32), begin, first


class Models:
    """Log-probabilities of n-grams by hash slot and language, from texts by language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        self.logp = np.zeros((1 << _BITS, max(1, len(self.names))), np.float32)
        for k, name in enumerate(self.names):
            counts = np.zeros(1 << _BITS)
            for _, _, raw, offsets in slices(lower(pa.array(texts[name], pa.large_string()))):
                counts += np.bincount(word_grams(raw, offsets)[0], minlength=1 << _BITS)
            self.logp[:, k] = np.log((counts + _SMOOTH) / (counts.sum() + _SMOOTH * (1 << _BITS)))

    def likelihoods(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each word in each language, first word of each document)."""
        slot, begin, first = word_grams(raw, offsets)
        if len(begin) == 0:
            return np.zeros((0, self.logp.shape[1]), np.float32), first
        return np.add.reduceat(self.logp[slot], begin, axis=0), first


def em(p: np.ndarray, counts: np.ndarray, allowed: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Proportions by document at convergence, from equal shares of the allowed languages; p holds each word's relative likelihoods, all documents have words."""
    out = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    open_ = np.arange(len(counts))
    share, own = out, counts
    for _ in range(iterations):
        r = p * np.repeat(share, own, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, np.cumsum(own) - own, axis=0) / own[:, None].astype(np.float32)
        moving = np.abs(new - share).max(axis=1) > TOLERANCE
        out[open_] = share = new
        if not moving.any():
            break
        if moving.mean() < 0.7:  # documents that have converged are left out
            p, share, own, open_ = p[np.repeat(moving, own)], share[moving], own[moving], open_[moving]
    return out


def _fit_of(p: np.ndarray, top: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log-likelihood of each document under its proportions."""
    first = np.cumsum(counts) - counts
    each = np.log(np.maximum((p * np.repeat(share, counts, axis=0)).sum(axis=1), 1e-30)) + top
    return np.add.reduceat(each.astype(np.float64), first)


def infer(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the chosen languages (0 for the others) by document; all 0 for one without words."""
    out = np.zeros((len(first) - 1, x.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some) == 0:
        return out
    counts = np.diff(first)[some]
    begin = np.cumsum(counts) - counts
    top = x.max(axis=1)
    single = np.add.reduceat(x.astype(np.float64), begin, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(some), x.shape[1]), bool)
    chosen[np.arange(len(some)), best] = True
    shares = chosen.astype(np.float32)
    fit = single[np.arange(len(some)), best]
    penalty = 0.5 * np.log(counts) + PENALTY * counts
    # no mixture fits better than each word in its best language
    open_ = np.flatnonzero((np.add.reduceat(top.astype(np.float64), begin) - fit > penalty) & (x.shape[1] > 1))
    if len(open_):
        rows = np.repeat(np.isin(np.arange(len(some)), open_), counts)
        p, top, counts = np.exp(x[rows] - top[rows, None]), top[rows], counts[open_]
        full = em(p, counts, np.ones((len(open_), x.shape[1])))
        refused = np.zeros(full.shape, bool)
        while len(open_):
            # the likeliest language that isn't in the set and wasn't refused since it last grew
            new = np.where(chosen[open_] | refused, -1, full).argmax(axis=1)
            trial = chosen[open_].copy()
            trial[np.arange(len(open_)), new] = True
            share = em(p, counts, trial)
            gained = _fit_of(p, top, counts, share)
            better = (gained - fit[open_] > penalty[open_]) & (np.where(trial, share, 1).min(axis=1) >= np.minimum(LEAST_SHARE, LEAST_WORDS / counts))
            at = open_[better]
            chosen[at], shares[at], fit[at] = trial[better], share[better], gained[better]
            refused[np.arange(len(open_)), new] = True
            refused[better] = False
            going = ~(chosen[open_] | refused).all(axis=1)
            rows = np.repeat(going, counts)
            p, top, counts, full, refused, open_ = p[rows], top[rows], counts[going], full[going], refused[going], open_[going]
    out[some] = shares
    return out


def fit(docs: DataFrame, labelled: DataFrame | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_a_language: int = ROWS_A_LANGUAGE) -> Models:
    """Models of the languages in ``labelled`` (``docs`` if none), each from its ``rows_a_language`` rows with the least digests of their ids.

    Rows with a null language, id or text are left out. Rows that repeat an id in a language take
    a place each in the choice, but count once, with their least text.
    """
    source = docs if labelled is None else labelled
    rows = source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null")
    keys = rows.select("lang", F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("digest"), "doc_id").alias("key"))
    # a rank below a limit: Spark drops all but the least rows of a task before the shuffle
    chosen = keys.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= rows_a_language)
    chosen = chosen.select(F.col("key.doc_id").alias("doc_id"), "lang").distinct()
    one = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    got = sorted((r.lang, r.doc_id, r.text) for r in one.toLocalIterator())
    texts: dict[str, list[str]] = {}
    for lang, _, text in got:
        texts.setdefault(lang, []).append(text)
    return Models(texts)


def identify(docs: DataFrame, labelled: DataFrame | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_a_language: int = ROWS_A_LANGUAGE) -> DataFrame:
    """(doc_id, language, share, languages, n_languages) of every row.

    ``language`` has the largest share, ties by name; ``languages`` joins the chosen set by
    commas, largest share first. A text without a word, null or empty ones among them, is
    "und" with share 0, and so is every text where there are no labelled rows.

    One pass without a shuffle, after the models are fitted. Each row is judged by itself, so
    rows that repeat give their results again, and null ids are kept. Texts are read whole.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled, lang_col, id_col, text_col, rows_a_language))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            language, share, languages, n = [], [], [], []
            for a, b, raw, offsets in slices(lower(batch.column(1))):
                if not models.names:
                    found = np.zeros((b - a, 1), np.float32)
                else:
                    found = infer(*models.likelihoods(raw, offsets))
                ranked = np.argsort(-found, axis=1, kind="stable")
                held = (found > 0).sum(axis=1)
                for i in range(b - a):
                    names = [models.names[k] for k in ranked[i, : held[i]]]
                    language.append(names[0] if names else UNKNOWN)
                    share.append(round(float(found[i, ranked[i, 0]]), 4))
                    languages.append(",".join(names) or UNKNOWN)
                    n.append(len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(share, pa.float64()), pa.array(languages, pa.string()), pa.array(n, pa.int32())], ["doc_id", "language", "share", "languages", "n_languages"])

    return rows.mapInArrow(run, "doc_id long, language string, share double, languages string, n_languages int")
