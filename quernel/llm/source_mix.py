"""Mixing sources to target weights by a low-discrepancy schedule (operator 5).

The documents of each source, shuffled by a digest of their ids, form a stream of tokens that is cut
into blocks of equal length. Slot i of the schedule maps the golden-ratio point frac(i * phi)
through the cumulative weights to a source; the k-th slot of a source takes its k-th block,
starting again after the last. There are just as many slots as it takes for every block to come once.

Points are integers modulo ``MODULUS``, so they are exact in a schedule of any length, and how many of
the first n fall into an interval is known in closed form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialize, small

MODULUS = 1 << 62
#: The golden ratio's part of the modulus.
STEP = (math.isqrt(5 << 124) - MODULUS) >> 1 | 1
#: Weights count in billionths, so that all systems cut the unit interval at the same places; none is less than one.
UNIT = 1_000_000_000
#: Sources that a schedule can have: their bounds are broadcast (24 bytes each). More raise an error.
MAX_SOURCES = 1_000_000
_CHUNK = 65_536


def token_count(text):
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.expr(f"regexp_extract_all({text}, '[^ \\\\t\\\\n\\\\r]+', 0)")), F.lit(0)).cast("long")


def _running(df: DataFrame, group: str, chunk: str, order: list, value, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of ``group``, where ``chunk`` grows along the order.

    Sums by chunk come first and are added up, so no window holds more than a chunk: a hot group
    doesn't end in one task.
    """
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("sum"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, chunk, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [group, chunk]).withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("base")


def _floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of floor((a * i + b) / m) for i from 0 to n - 1."""
    total = 0
    while True:
        total += (n - 1) * n // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            return total
        n, m, a, b = top // m, a, m, top % m


def points_below(slots: int, bound: int) -> int:
    """How many of the first ``slots`` points are less than ``bound``."""
    return _floor_sum(slots, MODULUS, STEP, 0) - _floor_sum(slots, MODULUS, STEP, MODULUS - bound) + slots if slots else 0


def _slots(need: list[int], high: list[int]) -> int:
    """The least number of slots in which each source has as many as it needs."""

    bounds = list(zip(need, [0, *high], high, strict=False))

    def enough(n: int) -> bool:
        # the first n points miss an interval's share by less than this (Kuipers and Niederreiter, theorem 2.3.4): only close cases are counted
        miss = 4 + 4 * math.log(n + 1)
        close = (x for x in bounds if n * ((x[2] - x[1]) / MODULUS) < x[0] + miss)
        return all(points_below(n, b) - points_below(n, a) >= k for k, a, b in close)

    most = 1
    while not enough(most):
        most *= 2
    low = most // 2
    while most - low > 1:
        half = (low + most) // 2
        low, most = (low, half) if enough(half) else (half, most)
    return most


def _chosen(high: np.ndarray):
    """Batches (slot) -> (slot, the number of its source, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            point = (slot.astype(np.uint64) * np.uint64(STEP)) & np.uint64(MODULUS - 1)
            number = np.searchsorted(high, point.astype(np.int64), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(slot // _CHUNK)], ["slot", "number", "chunk"])

    return run


def _schedule(docs: DataFrame, weights: dict[str, float] | None, power: float, block_tokens: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all documents, the schedule with ``head``: whether a piece is a document's first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "source", token_count("text").alias("tokens"))
    units = materialize(rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")))
    found = units.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a schedule has at most {MAX_SOURCES} sources")
    totals = {r.source: r.tokens for r in sorted(found, key=lambda r: r.source)}
    raw = {s: float(weights.get(s, 0)) if weights is not None else max(t, 1) ** power for s, t in totals.items()}
    raw = {s: w for s, w in raw.items() if w > 0}
    whole = sum(raw.values())
    share = [max(1, round(w / whole * UNIT)) for w in raw.values()]
    high = [int(x) * MODULUS // sum(share) for x in np.cumsum(share)]
    blocks = [max(1, -(-totals[s] // block_tokens)) for s in raw]
    cut = spark.createDataFrame(pa.table({"number": pa.array(range(len(raw)), pa.int64()), "source": pa.array(list(raw), pa.string()), "blocks": pa.array(blocks, pa.int64())}))
    slots = _slots(blocks, high) if raw else 0
    chosen = spark.range(slots).mapInArrow(_chosen(np.array(high, np.int64)), "slot long, number long, chunk long")
    ranked = _running(chosen, "number", "chunk", ["slot"], F.lit(1), "turn").join(F.broadcast(cut), "number")
    ranked = ranked.select("slot", "source", (F.col("turn") % F.col("blocks")).alias("block"), F.floor(F.col("turn") / F.col("blocks")).alias("epoch"))

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    shuffled = units.join(F.broadcast(cut), "source").withColumn("digest", digest).withColumn("chunk", F.substring("digest", 1, 3))
    placed = _running(shuffled, "source", "chunk", ["digest", F.col("doc_id").asc_nulls_first()], F.col("tokens"), "start")
    top = F.col("blocks") - 1
    last = F.greatest(F.floor((F.col("start") + F.col("tokens") - 1) / block_tokens), F.floor(F.col("start") / block_tokens))
    pieces = placed.select("source", "doc_id", "start", "tokens", F.explode(F.sequence(F.least(F.floor(F.col("start") / block_tokens), top), F.least(last, top))).alias("block"))
    edge = F.col("block") * block_tokens
    first = F.greatest(F.col("start") - edge, F.lit(0))
    pieces = pieces.select("source", "block", "doc_id", first.alias("first_token"), (F.least(F.col("start") + F.col("tokens") - edge, F.lit(block_tokens)) - first).alias("n_tokens"), (F.col("start") >= edge).alias("head"))
    return units, ranked.join(pieces, ["source", "block"]).select("slot", "source", "block", "epoch", "doc_id", "first_token", "n_tokens", "head")


def source_schedule(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.8, block_tokens: int = 2048, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(slot, source, block, epoch, doc_id, first_token, n_tokens): the piece of a document in each slot of the mixture.

    Weights default to the sources' token counts to the given power; given ones are scaled to
    sum 1, and a source that has none, or none above 0, takes no slot. Every other source has all
    its blocks in the schedule, however small its weight. A block is ``block_tokens`` long but for
    the last of a source; first_token is the piece's place in its block. A document without tokens
    (null or empty text) is a piece of length 0; a long one has a piece in each of its blocks.

    A null source is the source "". Rows that share an id are one document with the sum of their
    tokens, of the least source; null ids likewise. Ties in the digest go by id. Other columns,
    whatever their names, are not read. An empty table gives no rows. More than ``MAX_SOURCES``
    sources raise ValueError.
    """
    return _schedule(docs, weights, power, block_tokens, id_col, source_col, text_col)[1].drop("head")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.8, block_tokens: int = 2048, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in the mixture, each as often as its first block has a slot, in the same columns, whatever their names.

    With the default weights every row comes once at least; sources below their target come again.
    Rows that share an id, null ids among them, come equally often; null and empty texts come with
    the block that they stand in. An empty table stays empty. Ids that come once are not joined;
    the others are broadcast up to ``BROADCAST_ROWS``, and only beyond do texts take part in a shuffle.
    """
    units, plan = _schedule(docs, weights, power, block_tokens, id_col, source_col, text_col)
    name, turns = fresh_name(docs, "mixed_id"), fresh_name(docs, "mixed_turns")
    counts = plan.where("head").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    counts = counts.select(F.col("doc_id").alias(name), F.col("n").alias(turns))
    other = units.select("doc_id").join(counts, F.col("doc_id").eqNullSafe(counts[name]), "left").select(F.col("doc_id").alias(name), F.coalesce(turns, F.lit(0)).alias(turns))
    other = small(materialize(other.where(F.col(turns) != 1)))
    joined = docs.join(other, docs[id_col].cast("long").eqNullSafe(other[name]), "left")
    again = F.explode(F.array_repeat(F.lit(0), F.coalesce(other[turns], F.lit(1))))
    return joined.select(*[docs[c] for c in docs.columns], again.alias(fresh_name(docs, "mixed_turn"))).select(*docs.columns)
