"""Quality rules in a short-circuit cascade (operator 4).

On a sample each rule's cost and its rejections are measured. Costs come from jobs that apply one
rule alone to many copies of the sampled texts, in rounds that go through all rules in turn; the
median of the rounds counts, less that of a job without a rule, and differences within the spread
of such jobs count as equal. Rules are then ordered by rejections per cost: first the best one, next the
best one on what the first ones keep, and so on. The cascade is one expression in which a rule is
evaluated only for documents that all earlier rules keep; it runs inside the JVM in one pass over
the texts. The order changes the time that it takes, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialize

#: Documents that costs and selectivities are estimated on.
SAMPLE_ROWS = 2000
#: Times that a job applies a rule to each of them, and rounds of jobs.
COPIES = 4
ROUNDS = 3
_SPACES = " \t\n\x0b\f\r"
_WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Text:
    """A text that isn't null, with the counts that several rules need, made once a document."""

    text: Column
    words: Column
    length: Column


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def _removed(t: Text, pattern: str) -> Column:
    """How many characters match the class."""
    return t.length - F.length(F.regexp_replace(t.text, pattern, ""))


def _ink(t: Text) -> Column:
    """Characters that aren't white space."""
    out = t.text
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return F.length(out)


def _letting(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not wherever a lambda mentions it."""
    return F.transform(F.array(value), body)[0]


#: A rule says of a text whether it is kept.
RULES: dict[str, Callable[[Text], Column]] = {
    # three words at least
    "words": lambda t: t.words >= 3,
    # words of 2.5 to 12 characters on average
    "word_length": lambda t: _letting(_ink(t), lambda ink: (ink * 2 >= t.words * 5) & (ink <= t.words * 12)),
    # at most a symbol for ten words
    "symbols": lambda t: _removed(t, r"[#%&*$<>{}=~^\\]+") * 10 <= F.greatest(t.words, F.lit(10)),
    # at most a bar for five words
    "bars": lambda t: (t.length - F.length(F.replace(t.text, F.lit("|"), F.lit("")))) * 5 <= F.greatest(t.words, F.lit(5)),
    # at most an exclamation mark for five words
    "shouting": lambda t: (t.length - F.length(F.replace(t.text, F.lit("!"), F.lit("")))) * 5 <= F.greatest(t.words, F.lit(5)),
    # at most a third of the characters in capitals
    "capitals": lambda t: _removed(t, "[A-Z]+") * 3 <= F.greatest(t.length, F.lit(100)),
    # at most 60 % of the characters are digits
    "digits": lambda t: _removed(t, "[0-9]+") * 5 <= t.length * 3,
    # at most half of the lines repeat another one
    "lines": lambda t: _letting(F.split(t.text, "\n"), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))) * 2 <= F.size(lines)),
    # at most a fifth of the words are followed by the same word
    "repeats": lambda t: F.regexp_count(t.text, F.lit(r"(?<![^ \t\n\x0B\f\r])([^ \t\n\x0B\f\r]++)(?=[ \t\n\x0B\f\r]+\1(?![^ \t\n\x0B\f\r]))")) * 5 <= F.greatest(t.words, F.lit(10)),
}


def sample(texts: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` of the texts, spread over the whole table."""
    total = texts.count()
    return materialize(texts.sample(min(1.0, rows / max(total, 1)), seed=7))


def estimate(texts: DataFrame, rules: dict[str, Callable[[Text], Column]], rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[tuple[frozenset[str], int]]]:
    """(seconds a rule takes on the sample, how many sampled texts each set of rules rejects)."""
    text = F.coalesce("text", F.lit(""))
    some = sample(texts.select(text.alias("text")), rows).withColumns({"words": count_words(F.col("text")), "length": F.length("text")})
    # a column of the table: what rules share isn't theirs to pay
    some = materialize(some.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism // 2)))
    t = Text(F.col("text"), F.col("words"), F.col("length"))
    many = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    jobs = {"": F.col("length") >= 0, **{name: rule(t) for name, rule in rules.items()}}
    took: dict[str, list[float]] = {name: [] for name in jobs}
    for _ in range(ROUNDS):
        for name, column in jobs.items():
            began = time.perf_counter()
            many.agg(F.count_if(column)).collect()
            took[name].append(time.perf_counter() - began)
    idle = took.pop("")
    least = max(max(idle) - min(idle), 1e-3)
    cost = {name: max(median(x) - median(idle), least) for name, x in took.items()}
    names = list(rules)
    flags = [F.coalesce(rule(t), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    patterns = some.select(*flags).groupBy(*[f"r{i}" for i in range(len(names))]).count().collect()
    return cost, [(frozenset(n for n, ok in zip(names, p, strict=False) if not ok), p["count"]) for p in patterns]


def order(cost: dict[str, float], rejected: list[tuple[frozenset[str], int]]) -> list[str]:
    """Greedy: the rule with the most rejections per cost among the texts that the earlier ones keep; ties by cost, then by name."""
    left, out = list(cost), []
    while left:
        gain = {n: sum(c for r, c in rejected if n in r) / cost[n] for n in left}
        best = min(left, key=lambda n: (-gain[n], cost[n], n))
        out.append(best)
        left.remove(best)
        rejected = [(r, c) for r, c in rejected if best not in r]
    return out


def cascade(text: Text, rules: dict[str, Callable[[Text], Column]], names: list[str]) -> Column:
    """Whether all rules keep a text; a later rule isn't evaluated once an earlier one rejects."""
    out = F.lit(True)
    for name in reversed(names):
        out = F.when(~F.coalesce(rules[name](text), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def _judged(docs: DataFrame, rules: dict[str, Callable[[Text], Column]] | None, text_col: str, rows: int) -> tuple[DataFrame, Column]:
    """(``docs`` with the shared counts, whether a row is kept)."""
    rules = RULES if rules is None else rules
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    names = order(*estimate(texts, rules, rows)) if len(rules) > 1 else list(rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = fresh_name(docs, "words")
    return docs.withColumn(words, count_words(text)), cascade(Text(text, F.col(words), F.length(text)), rules, names)


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, keep) of every row: whether all rules keep its text.

    A null text is judged as an empty one, which the rules reject for its want of words; a rule
    whose value is null rejects. Texts are read whole. Rows are judged one by one, in one pass
    without a shuffle, so rows that repeat give their results again, and null ids are kept. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    counted, keep = _judged(docs.select(id_col, text_col), rules, text_col, sample_rows)
    return counted.select(F.col(id_col).cast("long").alias("doc_id"), keep.alias("keep"))


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Text], Column]] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text all rules keep, in the same columns, whatever their names; rows that repeat stay or go together."""
    counted, keep = _judged(docs, rules, text_col, sample_rows)
    return counted.where(keep).select(*docs.columns)
