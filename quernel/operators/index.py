"""An inverted index held as DataFrames.

``postings`` (field, doc_id, term, total, positions) has a row for each term of each document's
field, ``field_docs`` (field, doc_id) one for each document that has the field. Both are lazy; every
change gives a new index over new ones. Numbers of documents, terms and norms are derived.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches
from ..functions.analysis import IDENTITY, Pipeline, Token, tokens, words
from ..functions.batches import Sought
from ..plans import compiler, dsl

POSITION = "struct<start:int,len:int>"


@dataclass(frozen=True)
class FieldConfig:
    """How a field is analysed. Without ``store_positions`` hits have no places and analysis is cheaper; ``store_documents`` is kept for whoever stores the index."""

    pipeline: Pipeline
    query_pipeline: Pipeline | None = None
    store_documents: bool = True
    store_positions: bool = True


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column, T.DataType]]:
    """(dotted name, column, type) of all leaves of nested records; map columns stay one leaf."""
    out = []
    for f in schema.fields:
        path = f"{prefix}`{f.name}`"
        name = path.replace("`", "")
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, f"{path}.")
        else:
            out.append((name, F.col(path), f.dataType))
    return out


@dataclass(frozen=True)
class Index:
    """A named collection of documents; fields are registered before documents are added."""

    name: str
    ref: str
    pipeline: Pipeline
    fields: dict[str, FieldConfig]
    postings: DataFrame | None = None
    field_docs: DataFrame | None = None
    stats: DataFrame | None = None
    #: (postings of the terms sought, counts, field_docs, texts unless some are lists) of some fields alone, where the index is still the analysis of one table: one scan for all of them.
    build: Callable[[frozenset[str] | None, Sought | None], tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]] | None = field(default=None, compare=False)

    @classmethod
    def new(cls, name: str | None = None, ref: str = "id", pipeline: Pipeline | None = None) -> Index:
        """An index without documents; the pipeline is the default of its fields, an empty one if not given."""
        return cls(name or str(uuid.uuid4()), ref, pipeline or Pipeline(), {ref: FieldConfig(Pipeline([IDENTITY]), store_documents=False, store_positions=False)})

    # fields

    def add_field(self, name: str, pipeline: Pipeline | None = None, query_pipeline: Pipeline | None = None, store_documents: bool = True, store_positions: bool = True) -> Index:
        return replace(self, fields={**self.fields, name: FieldConfig(pipeline or self.pipeline, query_pipeline, store_documents, store_positions)})

    def update_field(self, name: str, **changes: Any) -> Index:
        return replace(self, fields={**self.fields, name: replace(self.get_field(name), **changes)})

    def get_field(self, name: str) -> FieldConfig:
        if name not in self.fields:
            raise ValueError(f"Unknown field {name} in index {self.name}")
        return self.fields[name]

    def get_fields(self) -> list[str]:
        return list(self.fields)

    def set_query_pipeline(self, name: str, pipeline: Pipeline) -> Index:
        return self.update_field(name, query_pipeline=pipeline)

    def save_document(self, save: bool) -> Index:
        return replace(self, fields={n: replace(c, store_documents=save) for n, c in self.fields.items()})

    def field(self, name: str) -> Field:
        self.get_field(name)
        return Field(self, name)

    # documents

    def _values(self, docs: DataFrame) -> tuple[Index, Column, list[tuple[str, Column, T.DataType]]]:
        """The index with the leaves of nested fields registered, the ids' column, and each field's (name, column, type)."""
        leaves = flatten(docs.schema)
        ref = next((c for n, c, _ in leaves if n == self.ref), None)
        if ref is None:
            raise ValueError(f"documents have no attribute {self.ref}")
        fields, values = dict(self.fields), []
        for name, column, kind in leaves:
            if isinstance(kind, T.MapType):
                # each key is a field of its own: names are only known from the data, so they must be registered
                values += [(f, column[f.removeprefix(f"{name}.")], kind.valueType) for f in self.fields if f.startswith(f"{name}.")]
                continue
            owner = name if name in fields else next((p for p in sorted(self.fields, key=len, reverse=True) if name.startswith(f"{p}.")), None)
            if owner is None:
                continue
            fields.setdefault(name, self.fields[owner])
            values.append((name, column, kind))
        return replace(self, fields=fields), ref, values

    def _rows(self, docs: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
        """(doc_id, field, text, given): what each document has in each field, or in some; one scan of the columns that they need."""
        _, ref, values = self._values(docs)
        cells = []
        for name, column, kind in values:
            if only is not None and name not in only:
                continue
            given = isinstance(kind, T.ArrayType)
            text = F.lit(None) if given else F.when(column, "true") if isinstance(kind, T.BooleanType) else column
            cells.append((F.lit(name).alias("field"), text.cast("string").alias("text"), (column if given else F.lit(None)).cast("array<string>").alias("given")))
        if len(cells) == 1:
            rows = docs.select(ref.alias("doc_id"), *cells[0])
        else:
            rows = docs.select(ref.alias("doc_id"), F.inline(F.array(*[F.struct(*c) for c in cells])))
        return rows.where("doc_id is not null and (text is not null or given is not null)")

    def _analysed(self, rows: DataFrame, listed: frozenset[str], only: frozenset[str] | None = None, sought: Sought | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, counts) of (doc_id, field, text, given), of which each (doc_id, field) is one row; ``listed`` fields may have terms as they are.

        Texts whose pipelines allow it are analysed a batch at a time; other fields of one pipeline share a pass of their words.
        """
        bulk: dict[str, tuple[Pipeline, bool]] = {}
        groups: dict[tuple[Pipeline, bool], list[str]] = {}
        for name, config in self.fields.items():
            if only is not None and name not in only:
                continue
            if name not in listed and batches.fits(config.pipeline):
                bulk[name] = config.pipeline, config.store_positions
            else:
                groups.setdefault((config.pipeline, config.store_positions), []).append(name)
        parts, counts = [], []
        if bulk:
            texts = rows.where(F.col("field").isin(*bulk))
            parts.append(batches.postings(texts, bulk, sought))
            counts.append(batches.frequencies(texts, bulk))
        for (pipeline, placed), names in groups.items():
            unplaced = lambda array: F.transform(array, lambda t: F.struct(t.alias("token"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len")))
            of_text = tokens(F.col("text"), pipeline.separator) if placed else unplaced(words(F.col("text"), pipeline.separator))
            found = rows.where(F.col("field").isin(names)).select("field", "doc_id", F.explode(F.coalesce(of_text, unplaced(F.col("given")))).alias("t"))
            found = found.select("field", "doc_id", F.struct("t.start", "t.len").alias("position"), F.col("t.token").alias("term"))
            found = pipeline.apply(found)
            held = F.array_sort(F.collect_list(F.when(F.col("position.start").isNotNull(), F.col("position")))) if placed else F.array()
            parts.append(found.groupBy("field", "doc_id", "term").agg(F.count("*").alias("total"), held.cast(f"array<{POSITION}>").alias("positions")))
            counts.append(_counted(parts[-1]))
        return functools.reduce(DataFrame.unionByName, parts), functools.reduce(DataFrame.unionByName, counts)

    def add_documents(self, docs: DataFrame, unique: bool | None = None) -> Index:
        """Adds what isn't there yet: a document's field is skipped if the index has that field of that id.

        Of rows that share an id the first counts. That takes a shuffle of the texts, which
        ``unique`` (ids don't repeat) saves; if it isn't given, the ids alone are looked at first.
        """
        index, ref, values = self._values(docs)
        listed = frozenset(name for name, _, kind in values if isinstance(kind, T.ArrayType))
        if unique is None:
            unique = docs.select(ref.alias("id")).where("id is not null").groupBy("id").count().where("count > 1").isEmpty()

        def build(only: frozenset[str] | None = None, sought: Sought | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
            rows = index._rows(docs, only)
            if not unique:
                # partitioned by (doc_id, field), so that counting terms needs no further shuffle
                rows = rows.withColumn("__at", F.monotonically_increasing_id())
                rows = rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("text", "given"), "__at").alias("v")).select("doc_id", "field", "v.text", "v.given")
            if self.field_docs is not None:
                rows = rows.join(self.field_docs, ["field", "doc_id"], "left_anti")
            return *index._analysed(rows, listed, only, sought), rows.select("field", "doc_id"), None if listed and (only is None or only & listed) else rows

        new, _, ids, _ = build()
        if self.postings is None:
            return replace(index, postings=new, field_docs=ids, stats=None, build=build)
        return replace(index, postings=self.postings.unionByName(new), field_docs=self.field_docs.unionByName(ids), stats=None, build=None)

    def update_documents(self, docs: DataFrame, unique: bool | None = None) -> Index:
        """Replaces the fields that the new documents have; other fields stay."""
        if self.postings is None:
            return self.add_documents(docs, unique)
        touched = self._rows(docs).select("field", "doc_id").distinct()
        kept = replace(self, postings=self.postings.join(touched, ["field", "doc_id"], "left_anti"), field_docs=self.field_docs.join(touched, ["field", "doc_id"], "left_anti"), build=None)
        return kept.add_documents(docs, unique)

    def remove_documents(self, ids: DataFrame | Iterable[Any]) -> Index:
        """Without the documents of these ids (a DataFrame's first column, or values); unknown ones are skipped."""
        if self.postings is None:
            return self
        if not isinstance(ids, DataFrame):
            kind = self.field_docs.schema["doc_id"].dataType
            ids = self.field_docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", kind)]))
        ids = ids.select(F.col(f"`{ids.columns[0]}`").alias("doc_id")).where("doc_id is not null").distinct()
        return replace(self, postings=self.postings.join(ids, "doc_id", "left_anti"), field_docs=self.field_docs.join(ids, "doc_id", "left_anti"), stats=None, build=None)

    def parts(self, fields: Iterable[str], sought: Sought | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings, field_docs) of some fields; if terms are sought, postings of others may be missing."""
        only = frozenset(fields)
        if self.build is not None:
            postings, _, ids, _ = self.build(only, sought)
            return postings, ids
        own = F.col("field").isin(*sorted(only))
        return self._require().postings.where(own), self.field_docs.where(own)

    def counts(self, fields: Iterable[str] | None = None) -> DataFrame:
        """(field, term, df) of all fields or of some."""
        if self.build is not None:
            return self.build(None if fields is None else frozenset(fields), None)[1]
        return _counted(self._require().postings if fields is None else self.parts(fields)[0])

    def all(self) -> DataFrame:
        """The ids of all documents."""
        return self.parts([self.ref])[1].select("doc_id")

    def documents_size(self) -> int:
        """The largest number of ids in a field."""
        if self.field_docs is None:
            return 0
        return self.field_docs.groupBy("field").count().agg(F.max("count")).first()[0] or 0

    def _require(self) -> Index:
        if self.postings is None or self.field_docs is None:
            raise ValueError("the index has no documents")
        return self

    # statistics

    def field_stats(self, fields: Iterable[str] | None = None) -> DataFrame:
        """(field, n_docs, n_terms, norm): one row a field."""
        if self.stats is not None:
            return self.stats if fields is None else self.stats.where(F.col("field").isin(*fields))
        self._require()
        field_docs = self.field_docs if fields is None else self.parts(fields)[1]
        docs = field_docs.groupBy("field").agg(F.count("*").alias("n_docs"))
        terms = self.counts(fields).groupBy("field").agg(F.count("*").alias("n_terms"))
        n = F.coalesce("n_terms", F.lit(0))
        return docs.join(terms, "field", "left").select("field", "n_docs", n.alias("n_terms"), F.when(n > 0, 1 / F.sqrt(n)).otherwise(F.lit(0.0)).alias("norm"))

    def term_stats(self) -> DataFrame:
        """(field, term, df, idf)."""
        return self._require().counts().join(F.broadcast(self.field_docs.groupBy("field").agg(F.count("*").alias("n_docs"))), "field").select("field", "term", "df", idf("n_docs", "df").alias("idf"))

    # analysis and search

    def analyze(self, field: str, text: str | float | list[Token], is_query: bool = False) -> list[Token]:
        """Tokens of a text as the field sees it, by its query pipeline if it is a query and there is one."""
        config = self.get_field(field)
        return (config.query_pipeline if is_query and config.query_pipeline else config.pipeline).run(text)

    def terms(self, field: str, terms: list[Any], fuzziness: int = 0, minimum_should_match: int = 1, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, term, tf, positions, norm, idf): the entries that match; terms are strings or compiled regular expressions."""
        self.get_field(field)
        entries = compiler.entries(self._require(), dsl.Terms(field, terms, fuzziness=fuzziness, minimum_should_match=minimum_should_match))
        if docs is not None:
            entries = entries.join(docs.select(F.col(f"`{docs.columns[0]}`").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if minimum_should_match > 1:
            held = F.sum("mult").over(Window.partitionBy("doc_id"))
            entries = entries.withColumn("held", held).where(F.col("held") >= minimum_should_match)
        return entries.select("doc_id", "term", "tf", "positions", "norm", "idf")

    def match_many(self, field: str, asked: DataFrame, least: int = 1) -> DataFrame:
        """(item_id, doc_id, score, held): the documents that hold ``least`` of an item's terms or more, of many items at once, with the score of the best of them.

        ``asked`` has (item_id, term), each pair once, with terms as the field's pipeline makes them.
        """
        config, wanted = self._require().get_field(field), asked.select("term").distinct().withColumn("asked", F.lit(True))
        counts = self.counts([field]).join(wanted, "term", "left")
        # as many terms as the items have
        terms = counts.agg(F.count("*").alias("n_terms"), F.collect_list(F.when(F.col("asked"), F.struct("term", "df"))).alias("asked"))
        known = self.parts([field])[1].agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(terms))
        known = known.where("n_terms > 0").select("n_docs", (1 / F.sqrt("n_terms")).alias("norm"), F.inline("asked")).select("term", F.pow(idf("n_docs", "df"), F.lit(2)).alias("weight"), "norm")
        pairs = asked.join(known, "term").select("item_id", "term", "weight", "norm")
        if self.build is not None and batches.fits(config.pipeline):
            texts = self.build(frozenset([field]), None)[3]
            if texts is not None:
                return batches.matched(texts.select("doc_id", "text"), config.pipeline, pairs, least)
        found = self.parts([field])[0].join(pairs, "term").withColumn("score", F.sqrt("total") * F.col("weight") * F.col("norm"))
        return found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.count("*").alias("held")).where(F.col("held") >= least)

    def search(self, query: str | dict | None, options: dict | None = None, limit: int | None = None) -> DataFrame:
        """(ref, score, matched, positions), best first and then by id; with ``limit`` only the first ones.

        A text is matched against all fields, or with ``{"fields": {name: {"boost": b}}}`` against
        those; a dict holds a query under "query", or else a text for each field, with the options
        ``expand`` and ``bool`` ("or", "and").
        """
        tree = dsl.from_search(query, options or {}, [f for f in self.fields if f != self.ref])
        if tree is None:
            spark = self.postings.sparkSession if self.postings is not None else SparkSession.getActiveSession()
            kind = self.field_docs.schema["doc_id"].dataType.simpleString() if self.field_docs is not None else "string"
            return spark.createDataFrame([], f"ref {kind}, score double, matched bigint, positions {compiler.POSITIONS}")
        hits = compiler.compile_query(self._require(), tree).orderBy(F.desc("score"), F.asc("ref"))
        return hits if limit is None else hits.limit(limit)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def idf(n_docs: str, df: str) -> Column:
    return 1 + F.log10(F.col(n_docs) / (F.col(df) + 1))


@dataclass(frozen=True)
class Field:
    """The statistics of one field."""

    index: Index
    name: str

    @property
    def postings(self) -> DataFrame:
        self.index._require()
        return self.index.parts([self.name])[0]

    def _of(self, term: str | None) -> DataFrame:
        """The postings of one term."""
        self.index._require()
        return self.index.parts([self.name], Sought((term,) if isinstance(term, str) else ()))[0].where(F.col("term") == term)

    def documents(self) -> DataFrame:
        self.index._require()
        return self.index.parts([self.name])[1].select("doc_id")

    def distinct_terms(self) -> DataFrame:
        return self.postings.select("term").distinct()

    def term_frequency(self, term: str) -> DataFrame:
        """(doc_id, tf) of the documents that hold the term; no rows if it is unknown."""
        return self._of(term).select("doc_id", F.sqrt("total").alias("tf"))

    def has_token(self, term: str) -> bool:
        return not self._of(term).isEmpty()

    def length(self, kind: str = "ids", term: str | None = None) -> int:
        """How many ids the field has, or documents hold the term ("term", "tf"), or weights the term has ("idf": 0 or 1)."""
        if kind == "ids":
            return self.documents().count()
        held = self._of(term).count()
        return min(held, 1) if kind == "idf" else held

    def tokens(self) -> DataFrame:
        """(term, tf, idf, norm, documents): tf is the number of documents."""
        return self._described(self.postings)

    def get_token(self, term: str) -> DataFrame:
        """The row of one term; none if it is unknown."""
        return self._described(self._of(term))

    def _described(self, postings: DataFrame) -> DataFrame:
        own = self.index.field_stats([self.name]).select("n_docs", "norm")
        held = postings.groupBy("term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("doc_id")).alias("documents"))
        return held.crossJoin(F.broadcast(own)).select("term", "tf", idf("n_docs", "tf").alias("idf"), "norm", "documents")

    def analyze(self, text: str | float | list[Token], is_query: bool = False) -> list[Token]:
        return self.index.analyze(self.name, text, is_query)

    def terms(self, terms: list[Any], **options: Any) -> DataFrame:
        return self.index.terms(self.name, terms, **options)
