"""From text to terms: tokens with places, runners that change them, and pipelines of runners.

Each step exists as Spark columns, for documents, and in plain Python, for the few words of a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

#: Characters that end a token; a separator always matches single characters.
SEPARATOR = r"[ \t\n\x0B\f\r\-]"
#: English function words, the shortest first.
STOP_WORDS = tuple(
    "a i be he me we if of am an in on do no so to or as is us at it by my had did and she the are off all him can own who too her for nor our has was his tis its get let yet "
    "got not but you how may say why any said like able some were else have with will them whom from than been then when also into dear ever your twas does this hers says that "
    "what most just must they only could would since while there where these among which often other after their wants might least about every should rather either across "
    "cannot almost likely because neither however".split()
)


@dataclass(frozen=True)
class Token:
    """A term and where its raw text stands; no place for terms that come from no text."""

    token: str
    start: int | None = None
    len: int | None = None

    def update(self, token: str) -> Token:
        return replace(self, token=token)

    @property
    def position(self) -> tuple[int, int] | None:
        return None if self.start is None else (self.start, self.len)


@dataclass(frozen=True)
class Runner:
    """A step of a pipeline. ``column`` maps a term column to a term (null drops it) or, if ``expands``, to an array of terms; ``python`` does the same to one string."""

    name: str
    column: Callable[[Column], Column] = field(compare=False)
    python: Callable[[str], str | list[str] | None] = field(compare=False)
    expands: bool = False


def tokenize(text: str | float | None, separator: str = SEPARATOR) -> list[Token]:
    """Lower-case tokens of a string or number."""
    if text is None:
        return []
    out, start = [], 0
    for part in re.split(separator, str(text).lower()):
        if part:
            out.append(Token(part, start, len(part)))
        start += len(part) + 1
    return out


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[9, 10, 11, 12, 13, 32, 45]] = True
_PLACED = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType())]))


def _buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("")
    _, places, data = text.buffers()
    offsets = np.frombuffer(places, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _listed(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The tokens of each text, from their first and last bytes; places count characters."""
    size, inside = end - start, np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    token = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[np.cumsum(inside[:-1]) > 0]))])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = chars[offsets[np.searchsorted(offsets, start, "right") - 1]]
    rows = pa.StructArray.from_arrays([token.cast(pa.string()), pa.array((chars[start] - first).astype(np.int32)), pa.array((chars[end] - chars[start]).astype(np.int32))], ["token", "start", "len"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets).astype(np.int32)), rows)


@F.arrow_udf(_PLACED)
def _by_bytes(text: pa.Array) -> pa.Array:
    """Tokens between the usual separators, which are single bytes, found in the whole batch at once."""
    raw, offsets = _buffers(text)
    word = np.concatenate([[False], ~_IS_SEPARATOR[raw], [False]])
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return _listed(raw, offsets, start, end)


@F.arrow_udf(_PLACED)
def _by_pattern(text: pa.Array, separator: pa.Array) -> pa.Array:
    if len(text) == 0:
        return pa.array([], pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("len", pa.int32())])))
    made = [[{"token": t.token, "start": t.start, "len": t.len} for t in tokenize(x, separator[0].as_py())] for x in text.to_pylist()]
    return pa.array(made, pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("len", pa.int32())])))


def tokens(text: Column, separator: str = SEPARATOR) -> Column:
    """An array of (token, start, len), without a shuffle; a null text has a null one.

    Places need a running sum over a text's words, which built-in functions only give in quadratic
    time: whole Arrow batches are cut at once instead.
    """
    lowered = F.lower(text.cast("string"))
    made = _by_bytes(lowered) if separator == SEPARATOR else _by_pattern(lowered, F.lit(separator))
    return F.when(lowered.isNotNull(), made)


def words(text: Column, separator: str = SEPARATOR) -> Column:
    """The tokens without places."""
    return F.array_remove(F.split(F.lower(text.cast("string")), separator, -1), "")


def trim_column(term: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(term, r"^\W+", ""), r"\W+$", "")


def trim(term: str) -> str:
    return re.sub(r"\W+\Z", "", re.sub(r"^\W+", "", term, flags=re.ASCII), flags=re.ASCII)


@F.pandas_udf(T.StringType())
def stem_column(term: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(term)
    found = pd.Series([stem(w) for w in distinct] + [None], dtype=object)
    return found.take(codes).reset_index(drop=True)


TRIMMER = Runner("trimmer", trim_column, trim)
STOP_WORD_FILTER = Runner("stop_word_filter", lambda t: F.when(~t.isin(*STOP_WORDS), t), lambda t: None if t in STOP_WORDS else t)
STEMMER = Runner("stemmer", stem_column, stem)
IDENTITY = Runner("identity", lambda t: t, lambda t: t)
_KNOWN: dict[str, Runner] = {r.name: r for r in (TRIMMER, STOP_WORD_FILTER, STEMMER, IDENTITY)}


def register(runner: Runner) -> Runner:
    """Makes a runner known by its name, so that stored indexes can name it."""
    _KNOWN[runner.name] = runner
    return runner


def runner(name: str) -> Runner:
    if name not in _KNOWN:
        raise ValueError(f"Unknown runner {name}")
    return _KNOWN[name]


def python_runner(name: str, call: Callable[[str], str | list[str] | None]) -> Runner:
    """A runner from a plain function that returns a term, a list of terms or None; on documents it runs over Arrow batches, once for each distinct term of a batch."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def column(term: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(term)
        found = [call(w) for w in distinct]
        lists = [[] if x is None else [x] if isinstance(x, str) else list(x) for x in found]
        return pd.Series([lists[c] if c >= 0 else [] for c in codes])

    return register(Runner(name, column, call, expands=True))


def default_runners() -> list[Runner]:
    return [TRIMMER, STOP_WORD_FILTER, STEMMER]


@dataclass(frozen=True)
class Pipeline:
    """An ordered list of distinct runners."""

    runners: tuple[Runner, ...] = ()
    separator: str = SEPARATOR

    def __init__(self, runners: Iterable[Runner] = (), separator: str = SEPARATOR):
        object.__setattr__(self, "runners", tuple(dict.fromkeys(runners)))
        object.__setattr__(self, "separator", re.sub(r"\+$", "", separator))

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.runners]

    def add(self, new: Runner) -> Pipeline:
        """In front of the others; one that is there already stays where it is."""
        return self if new in self.runners else Pipeline((new, *self.runners), self.separator)

    def remove(self, old: Runner) -> Pipeline:
        return Pipeline((r for r in self.runners if r != old), self.separator)

    def insert_before(self, anchor: Runner, new: Runner) -> Pipeline:
        return self._insert(anchor, new, 0)

    def insert_after(self, anchor: Runner, new: Runner) -> Pipeline:
        return self._insert(anchor, new, 1)

    def _insert(self, anchor: Runner, new: Runner, offset: int) -> Pipeline:
        if anchor not in self.runners:
            return self.add(new)
        at = self.runners.index(anchor) + offset
        return Pipeline((*self.runners[:at], new, *self.runners[at:]), self.separator)

    def run(self, text: str | float | list[Token] | None) -> list[Token]:
        """The tokens of a text, or of a list of tokens, in plain Python."""
        out = text if isinstance(text, list) else tokenize(text, self.separator)
        for r in self.runners:
            changed = []
            for token in out:
                got = r.python(token.token)
                changed += [token.update(t) for t in ([] if got is None else [got] if isinstance(got, str) else got)]
            out = changed
        return out

    def apply(self, rows: DataFrame, term: str = "term") -> DataFrame:
        """Rows of raw tokens in column ``term`` -> rows of terms; other columns go along."""
        others = [c for c in rows.columns if c != term]
        for r in self.runners:
            if r.expands:
                rows = rows.select(*others, F.explode(r.column(F.col(term))).alias(term))
            else:
                rows = rows.select(*others, r.column(F.col(term)).alias(term))
            rows = rows.where(F.col(term).isNotNull())
        return rows


def levenshtein(a: str, b: str) -> int:
    """Edit distance in characters of the lower-case strings."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
