"""Syntax trees to DataFrames of hits (ref, score, matched, positions).

All leaves of a query are looked up in one pass over the postings, whatever their number: a posting
carries its weight and which leaves it matches, one aggregation makes a row of a document with the
best score of every leaf, and the tree of clauses is an expression over that row. Conditions on field
and term reach the scan, document frequencies of exact terms and the few rows of field statistics are
broadcast, and unused positions are pruned. Only queries that match documents without any of
their terms join the ids of all documents.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Token
from ..functions.batches import Sought
from . import dsl

if TYPE_CHECKING:
    from ..operators.index import Index

POSITIONS = "map<string,array<struct<start:int,len:int>>>"


def compile_query(index: Index, node: dsl.Query) -> DataFrame:
    """The hits of a query, in no order."""
    tree = dsl.rewrite(node, lambda field, text: index.analyze(field, text, is_query=True))
    leaves = list(_leaves(tree))
    rows = _by_document(index, leaves) if leaves else None
    if _blank(tree)[0]:
        rows = index.all() if rows is None else index.all().join(rows, "doc_id", "left")
    elif rows is None:
        rows = index.all().where(F.lit(False))
    rows, hit = _evaluate(rows, tree, iter(range(len(leaves))), iter(range(1 << 30)))
    return rows.where(hit.match).select(F.col("doc_id").alias("ref"), hit.score.alias("score"), hit.matched.cast("bigint").alias("matched"), hit.positions.cast(POSITIONS).alias("positions"))


def _leaves(node: dsl.Query | None) -> Iterator[dsl.Terms]:
    """The terms queries of a tree, in the order in which ``_evaluate`` meets them."""
    if isinstance(node, dsl.Terms):
        yield node
    elif isinstance(node, dsl.Not):
        yield from _leaves(node.query)
    elif isinstance(node, dsl.Bool):
        for q in (node.must_not, *node.filter, node.must, *node.should):
            yield from _leaves(q)


def _blank(node: dsl.Query) -> tuple[bool, float]:
    """(whether it is a hit, score) of a document that matches no leaf."""
    if isinstance(node, dsl.MatchAll):
        return True, float(node.boost)
    if isinstance(node, dsl.Not):
        return not _blank(node.query)[0], 1.0
    if not isinstance(node, dsl.Bool):
        return False, 0.0
    base = None if node.must_not is None else (not _blank(node.must_not)[0], 1.0)
    for clause, least in [*((q, 0) for q in node.filter), *([(node.must, -math.inf)] if node.must is not None else [])]:
        match, score = _blank(clause)
        base = (match and score > least and (base is None or base[0]), score)
    should = [score for match, score in map(_blank, node.should) if match]
    score = sum(should) + (base[1] if base is not None else 0)
    return (base is None or base[0]) and (base is not None or bool(should)) and len(should) >= node.minimum_should_match and score > 0, score


@dataclass(frozen=True)
class _Hit:
    """Columns of a node over a row of a document: match is never null, the others count where it is true."""

    match: Column
    score: Column
    matched: Column
    positions: Column


def _evaluate(rows: DataFrame, node: dsl.Query, leaf: Iterator[int], name: Iterator[int]) -> tuple[DataFrame, _Hit]:
    nothing = F.lit(None).cast(POSITIONS)
    if isinstance(node, dsl.MatchAll):
        return rows, _Hit(F.lit(True), F.lit(1.0 * node.boost), F.lit(None), nothing)
    if isinstance(node, dsl.Terms):
        i = next(leaf)
        match = F.coalesce(F.col(f"held{i}") >= node.minimum_should_match, F.lit(False)) if node.minimum_should_match > 1 else F.col(f"score{i}").isNotNull()
        return rows, _Hit(match, F.col(f"score{i}") * F.lit(float(node.boost)), F.lit(None), F.create_map(F.lit(node.field), F.col(f"positions{i}")).cast(POSITIONS))
    if isinstance(node, dsl.Not):
        rows, inner = _evaluate(rows, node.query, leaf, name)
        return rows, _Hit(~inner.match, F.lit(1.0), F.lit(None), nothing)
    if not isinstance(node, dsl.Bool):
        raise ValueError(f"unknown query {node!r}")
    # scores of must (or else of the last filter, or 1 after must_not alone) plus those of the should clauses that match
    base = None
    if node.must_not is not None:
        rows, base = _evaluate(rows, dsl.Not(node.must_not), leaf, name)
    for clause, positive in [*((q, True) for q in node.filter), *([(node.must, False)] if node.must is not None else [])]:
        rows, hit = _evaluate(rows, clause, leaf, name)
        match = hit.match & (hit.score > 0) if positive else hit.match
        base = _Hit(match if base is None else base.match & match, hit.score, hit.matched, hit.positions)
    should = []
    for clause in node.should:
        rows, hit = _evaluate(rows, clause, leaf, name)
        should.append(hit)
    if base is None and not should:
        return rows, _Hit(F.lit(False), F.lit(0.0), F.lit(None), nothing)
    zero = F.lit(0.0)
    matched = functools.reduce(operator.add, [h.match.cast("bigint") for h in should], F.lit(0).cast("bigint"))
    score = functools.reduce(operator.add, [F.when(h.match, h.score).otherwise(zero) for h in should], zero if base is None else F.when(base.match, base.score).otherwise(zero))
    fields = _fields(node)
    none = F.array().cast("array<struct<start:int,len:int>>")

    def placed(field: str) -> Column:
        return F.flatten(F.array(*[F.coalesce(F.when(h.match, h.positions[field]), none) for h in should]))

    held = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), placed(f).alias("value")) for f in fields]), lambda e: F.size(e["value"]) > 0) if fields else None
    positions = F.map_from_entries(held).cast(POSITIONS) if fields else nothing
    # columns of its own, so that a clause is computed once however deep it stands
    k = next(name)
    rows = rows.withColumns({f"node{k}_score": score, f"node{k}_matched": matched, f"node{k}_allowed": F.lit(True) if base is None else base.match, f"node{k}_positions": positions})
    some = F.col(f"node{k}_allowed") & (F.col(f"node{k}_matched") >= node.minimum_should_match) & (F.col(f"node{k}_score") > 0)
    return rows, _Hit(some, F.col(f"node{k}_score"), F.col(f"node{k}_matched"), F.col(f"node{k}_positions"))


def _flags(pattern: re.Pattern) -> str:
    """A compiled pattern's flags as the JVM's inline ones."""
    other = pattern.flags & ~(re.I | re.M | re.S | re.X | re.A | re.U)
    if other:
        raise ValueError(f"patterns can't have the flags {re.RegexFlag(other)!r}")
    letters = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & f)
    # classes such as \\w and case know all of Unicode in Python unless re.A is set
    letters += "" if pattern.flags & re.A else "U" + "u" * ("i" in letters)
    return f"(?{letters})" if letters else ""


def _predicate(term: Any, expand: bool, fuzziness: int) -> Column:
    """Whether an indexed term matches one of the query's."""
    if isinstance(term, Token):
        term = term.token
    column = F.col("term")
    if isinstance(term, re.Pattern):
        return column.rlike(_flags(term) + term.pattern)
    text = term if isinstance(term, str) else str(term)
    if expand:
        return column.startswith(text)
    if fuzziness > 0:
        return F.levenshtein(column, F.lit(text), fuzziness).between(0, fuzziness)
    return column == text


def _texts(node: dsl.Terms) -> list[str] | None:
    """The exact terms of a leaf; None if it looks for others, too."""
    if node.expand or node.fuzziness > 0 or any(isinstance(t, re.Pattern) for t in node.terms):
        return None
    return [t.token if isinstance(t, Token) else t if isinstance(t, str) else str(t) for t in node.terms]


def _sought(leaves: list[dsl.Terms]) -> Sought | None:
    """What the leaves' terms begin with or are; None if that can't be said of some."""
    exact, prefixes = [], []
    for node in leaves:
        if (texts := _texts(node)) is not None:
            exact += texts
        elif node.expand and not any(isinstance(t, re.Pattern) for t in node.terms):
            prefixes += [t.token if isinstance(t, Token) else str(t) for t in node.terms]
        else:
            return None
    return Sought(tuple(dict.fromkeys(exact)), tuple(dict.fromkeys(prefixes)))


def _matching(node: dsl.Terms) -> tuple[Column, Column, Column]:
    """(whether a posting of the leaf's field matches, how many of its terms it matches, which is the first)."""
    texts = _texts(node)
    if not node.terms:
        return F.lit(False), F.lit(0), F.lit(0)
    if texts is not None:
        # looked up in a literal map, so that a long list stays one expression
        known: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            known.setdefault(text, []).append(i)
        table = F.create_map(*[x for t, at in known.items() for x in (F.lit(t), F.struct(F.lit(len(at)).alias("mult"), F.lit(at[0]).alias("place")))])
        return F.col("term").isin(*known), table[F.col("term")]["mult"], table[F.col("term")]["place"]
    conditions = [_predicate(t, node.expand, node.fuzziness) for t in node.terms]
    mult = functools.reduce(operator.add, [c.cast("int") for c in conditions])
    return functools.reduce(operator.or_, conditions), mult, F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])


def _weighted(index: Index, leaves: list[dsl.Terms]) -> DataFrame:
    """The postings that match any leaf, with their weights: (doc_id, field, term, positions, tf, idf, norm)."""
    for node in leaves:
        index.get_field(node.field)
    fields = list(dict.fromkeys(node.field for node in leaves))
    postings, field_docs = index.parts(fields, _sought(leaves))
    by_field: dict[str, list[Column]] = {}
    for node in leaves:
        by_field.setdefault(node.field, []).append(_matching(node)[0])
    wanted = functools.reduce(operator.or_, [(F.col("field") == f) & functools.reduce(operator.or_, c) for f, c in by_field.items()])
    texts = [_texts(node) for node in leaves]
    if all(t is not None for t in texts) and (every := sorted({t for own in texts for t in own})):
        wanted = F.col("term").isin(*every) & wanted  # for the scan
    found = postings.where(wanted)
    if index.stats is not None:
        # a term's document frequency is right under a filter on terms
        df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
        own = index.field_stats(fields).select("field", "n_docs", "norm")
    else:
        # one more pass counts the terms that the norm needs, and the documents of the asked ones among them
        counts = index.counts(fields)
        asked = F.collect_list(F.when(wanted, F.struct("term", "df")))
        terms = counts.groupBy("field").agg(F.count("*").alias("n_terms"), asked.alias("asked"))
        docs = field_docs.groupBy("field").agg(F.count("*").alias("n_docs"))
        known = docs.join(F.broadcast(terms), "field").select("field", "n_docs", (1 / F.sqrt("n_terms")).alias("norm"), "asked")
        if all(t is not None for t in texts):
            every = known.select("field", "n_docs", "norm", F.inline("asked"))
            return _weights(found.join(F.broadcast(every), ["field", "term"]))
        df = counts.where(wanted)
        own = known.select("field", "n_docs", "norm")
    # as many rows as the query has exact terms; any number under other conditions
    df = F.broadcast(df) if all(t is not None for t in texts) else df
    return _weights(found.join(df, ["field", "term"]).join(F.broadcast(own), "field"))


def _weights(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "field", "term", "positions", F.sqrt("total").alias("tf"), (1 + F.log10(F.col("n_docs") / (F.col("df") + 1))).alias("idf"), "norm")


def entries(index: Index, node: dsl.Terms) -> DataFrame:
    """The postings that match, with their weights: (doc_id, term, positions, mult, place, tf, idf, norm).

    ``mult`` says how many of the query's terms a posting matches, ``place`` which of them is the first.
    """
    _, mult, place = _matching(node)
    return _weighted(index, [node]).select("doc_id", "term", "positions", mult.alias("mult"), place.alias("place"), "tf", "idf", "norm")


def _by_document(index: Index, leaves: list[dsl.Terms]) -> DataFrame:
    """A row of each document that matches a leaf: (doc_id, and score, held and positions of every leaf, null where it doesn't match).

    A document has the score of a leaf's best term; of equal ones the query's first, then the least.
    """
    score = F.col("tf") * F.pow("idf", F.lit(2)) * F.col("norm")
    found = _weighted(index, leaves).withColumn("score", score)
    out = []
    for i, node in enumerate(leaves):
        match, mult, place = _matching(node)
        own = (F.col("field") == node.field) & match
        out.append(F.max(F.when(own, F.col("score"))).alias(f"score{i}"))
        out.append(F.sum(F.when(own, mult)).alias(f"held{i}"))
        out.append(F.min_by("positions", F.when(own, F.struct(-F.col("score"), place, F.col("term")))).alias(f"positions{i}"))
    return found.groupBy("doc_id").agg(*out)


def _fields(node: dsl.Query) -> list[str]:
    """The fields that a node's hits can have positions in."""
    if isinstance(node, dsl.Terms):
        return [node.field]
    if isinstance(node, dsl.Bool):
        return list(dict.fromkeys(f for q in node.should for f in _fields(q)))
    return []
