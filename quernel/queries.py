"""Queries over the driver's tables, with the same results in DuckDB's SQL.

``documents`` is indexed with a trimmed text and its language and source, ``part`` with its name,
brand and type as they are. Scores are rounded to six decimals on both sides.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import DiskProvider, DocumentStore, Index, Manager, Pipeline, default_runners
from .functions import batches
from .functions.analysis import STEMMER, STOP_WORD_FILTER, STOP_WORDS, TRIMMER, Runner, tokens, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SEP = r"'[ \t\n\x0B\f\r\-]'"


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    index = Index.new("documents", ref="doc_id").add_field("text", pipeline=Pipeline([TRIMMER])).add_field("lang").add_field("source")
    return index.add_documents(table(spark, sf_dir, "documents"))


def parts_index(spark: SparkSession, sf_dir: str) -> Index:
    index = Index.new("parts", ref="p_partkey").add_field("p_name").add_field("p_brand").add_field("p_type")
    return index.add_documents(table(spark, sf_dir, "part"))


def _scored(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("ref", F.round("score", 6).alias("score"), *more)


# SQL blocks: p (field, doc_id, term, total), fd (field, doc_id), fs (field, n_docs, n_terms), e (field, doc_id, term, s)

_TRIM = r"regexp_replace(regexp_replace({0}, '^\W+', ''), '\W+$', '')"


def _postings_sql(source: str, key: str, fields: dict[str, bool]) -> str:
    """CTEs of an index over a table; fields say whether they are trimmed."""
    raw = " union all ".join(
        f"select '{c}' as field, doc_id, {_TRIM.format('t') if trimmed else 't'} as term from (select {key} as doc_id, unnest(string_split_regex(lower({c}::varchar), {_SEP})) as t from {source} where {c} is not null) where t <> ''" for c, trimmed in fields.items()
    )
    ids = " union all ".join(f"select '{c}' as field, {key} as doc_id from {source} where {c} is not null" for c in fields)
    return f"""p as (select field, doc_id, term, count(*)::bigint as total from ({raw}) group by 1, 2, 3),
        fd as ({ids}),
        df as (select field, term, count(*)::bigint as df from p group by 1, 2),
        fs as (select field, n_docs, coalesce(n_terms, 0)::bigint as n_terms, case when n_terms > 0 then 1 / sqrt(n_terms) else 0.0::double end as norm
            from (select field, count(*)::bigint as n_docs from fd group by 1) left join (select field, count(*)::bigint as n_terms from df group by 1) using (field)),
        i as (select field, term, df, n_docs, norm, 1 + log10(n_docs / (df + 1)) as idf from df join fs using (field)),
        e as (select field, doc_id, term, total, sqrt(total) * pow(idf, 2) * norm as s from p join i using (field, term))"""


_DOCS = _postings_sql("documents", "doc_id", {"text": True, "lang": False, "source": False})
_TEXT = _postings_sql("documents", "doc_id", {"text": True})
_PARTS = _postings_sql("part", "p_partkey", {"p_name": False, "p_brand": False, "p_type": False})


def _hits_sql(field: str, condition: str, boost: float = 1) -> str:
    return f"(select doc_id as ref, max(s) * {boost} as score, count(*) as n from e where field = '{field}' and {condition} group by 1)"


def _in(*terms: str) -> str:
    return "term in (" + ", ".join(f"'{t}'" for t in terms) + ")"


def _search(name: str, query, sql: str, index=documents_index, matched: bool = False, options: dict | None = None) -> None:
    """Registers a search."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = index(spark, sf_dir).search(query if isinstance(query, str) or options is not None else {"query": query}, options)
        return _scored(found, *(["matched"] if matched else []))

    QUERIES[name] = run
    SQL[name] = sql


# analysis


@_query(rf"select doc_id, t as term, count(*)::bigint as n from (select doc_id, unnest(string_split_regex(lower(text), {_SEP})) as t from documents) where t <> '' group by 1, 2")
def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_terms(spark, sf_dir, Pipeline())


@_query(rf"""
    with w as (select doc_id, string_split_regex(lower(text), {_SEP}) as w from documents),
    t as (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from w),
    s as (select doc_id, token, sum(len(token) + 1) over (partition by doc_id order by i) - len(token) - 1 as start from t)
    select doc_id, token, start::int as start, len(token)::int as len from s where token <> ''""")
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).select("doc_id", "t.token", "t.start", "t.len")


@_query("select page_id, t as term, count(*)::bigint as n from (select page_id, unnest(string_split_regex(lower(url), '[/?&]')) as t from pages) where t <> '' group by 1, 2")
def tokenize_custom_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(words(F.col("url"), "[/?&]")).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("n"))


@_query(rf"select o_orderkey, unnest(list_filter(string_split_regex(lower(o_orderkey::varchar || ' ' || o_orderpriority), {_SEP}), lambda t: t <> '')) as term from orders")
def tokenize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(words(text)).alias("term"))


def _text_terms(spark: SparkSession, sf_dir: str, pipeline: Pipeline) -> DataFrame:
    """Terms of each document by the library's own runners; rows that share an id count as one document, which takes a shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("text").alias("field"), "text").where("text is not null")
    found = batches.postings(docs, {"text": (pipeline, False)}).select("doc_id", "term", F.col("total").alias("n"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("doc_id", "term").agg(F.sum("n").alias("n"))


_TRIMMED = rf"select doc_id, {_TRIM.format('t')} as term from (select doc_id, unnest(string_split_regex(lower(text), {_SEP})) as t from documents) where t <> ''"


@_query(f"select doc_id, term, count(*)::bigint as n from ({_TRIMMED}) group by 1, 2")
def trim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_terms(spark, sf_dir, Pipeline([TRIMMER]))


@_query(f"select doc_id, term, count(*)::bigint as n from ({_TRIMMED}) where term not in ({', '.join(repr(w) for w in STOP_WORDS)}) group by 1, 2")
def stop_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_terms(spark, sf_dir, Pipeline([TRIMMER, STOP_WORD_FILTER]))


@_query()
def pipeline_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems can't be written in SQL; tests hold them against known pairs and the plain Python pipeline."""
    return _text_terms(spark, sf_dir, Pipeline(default_runners()))


#: Words by their stem.
STEMS = {
    "knit": "knits knitting knit knitted", "knock": "knocked knocking knock knocks", "consign": "consignment consigning consigned consign", "consol": "consols consoles consolation console consoled consolations consoling",
    "consist": "consists consisting consistency consist consistently consisted consistent", "consolid": "consolidating consolidate consolidated", "knee": "knees knee", "kneel": "kneels kneel kneeling kneeled", "tri": "try", "knive": "knives",
    "conspir": "conspiring conspirators conspire conspired conspirator", "constabl": "constables constable", "constanc": "constancy constance", "conspicu": "conspicuously conspicuous", "conspiraci": "conspiracy",
    "knack": "knack knacks", "knackeri": "knackeries", "knag": "knag", "knave": "knave knaves", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knob": "knob knobs",
    "knocker": "knocker knockers", "knopp": "knopp", "knot": "knot knots", "consolatori": "consolatory", "knavish": "knavish", "knead": "kneaded kneading", "knight": "knights knight", "conson": "consonant", "consort": "consorting consort consorted", "constant": "constant", "lay": "lay", "happili": "happily", "hope": "hoping", "hop": "hopping",
}
_PAIRS = sorted((w, s) for s, ws in STEMS.items() for w in ws.split())


@_query(rf"""
    with t as (select p_partkey, unnest(string_split_regex(lower(p_name || ' ' || p_type), {_SEP})) as t from part)
    select p_partkey, case t when 'economy' then 'economi' when 'large' then 'larg' else t end as term from t where t <> ''""")
def pipeline_default_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default pipeline over names and types, whose few words have known stems."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words(F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    return Pipeline(default_runners()).apply(rows)


@_query("select * from (values " + ", ".join(f"('{w}', '{s}')" for w, s in _PAIRS) + ") t(word, stem)")
def stemmer_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w, _ in _PAIRS], "word string").select("word", STEMMER.column(F.col("word")).alias("stem"))


def _widened(term: Column) -> Column:
    return F.when(term == "red", F.array(F.lit("red"), F.lit("scarlet"), F.lit("crimson"))).otherwise(F.array(term))


WIDEN = Runner("widen_red", _widened, lambda t: ["red", "scarlet", "crimson"] if t == "red" else t, expands=True)


@_query(rf"select p_partkey, unnest(case when t = 'red' then ['red', 'scarlet', 'crimson'] else [t] end) as term from (select p_partkey, unnest(string_split_regex(lower(p_name), {_SEP})) as t from part) where t <> ''")
def custom_runner_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words(F.col("p_name"))).alias("term"))
    return Pipeline([WIDEN]).apply(rows)


SYNONYMS = Runner("synonyms", lambda t: F.when(t == "tiny", F.array(F.lit("small"), F.lit("new"))).otherwise(F.array(t)), lambda t: ["small", "new"] if t == "tiny" else t, expands=True)


@_query(f"with {_PARTS} select ref, round(score, 6) as score from {_hits_sql('p_name', _in('small', 'new', 'ring'))}")
def query_pipeline_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = parts_index(spark, sf_dir).set_query_pipeline("p_name", Pipeline([SYNONYMS]))
    return _scored(index.search({"query": {"match": {"p_name": "tiny ring"}}}))


# statistics


@_query(f"with {_DOCS} select field, doc_id, term, total from p")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).postings.where("field <> 'doc_id'").select("field", "doc_id", "term", "total")


@_query(f"with {_TEXT} select doc_id, round(sqrt(total), 6) as tf from p where term = 'the'")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).field("text").term_frequency("the").select("doc_id", F.round("tf", 6).alias("tf"))


@_query(f"with {_DOCS} select field, term, df from df")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).term_stats().where("field <> 'doc_id'").select("field", "term", "df")


@_query(f"with {_DOCS} select field, term, round(idf, 6) as idf from i")
def idf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).term_stats().where("field <> 'doc_id'").select("field", "term", F.round("idf", 6).alias("idf"))


@_query(f"with {_DOCS} select field, n_docs, n_terms, round(norm, 9) as norm from fs")
def field_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).field_stats().where("field <> 'doc_id'").select("field", "n_docs", "n_terms", F.round("norm", 9).alias("norm"))


def _token_columns(df: DataFrame) -> DataFrame:
    return df.select("term", "tf", F.round("idf", 6).alias("idf"), F.round("norm", 6).alias("norm"), F.size("documents").cast("long").alias("n"), F.col("documents")[0].alias("least"))


_TOKENS = "select i.term, i.df as tf, round(i.idf, 6) as idf, round(i.norm, 6) as norm, count(*)::bigint as n, min(doc_id) as least from i join p using (field, term) where field = '{0}' and {1} group by 1, 2, 3, 4"


@_query(f"with {_PARTS} " + _TOKENS.format("p_name", "true"))
def field_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_columns(parts_index(spark, sf_dir).field("p_name").tokens())


@_query(f"with {_TEXT} " + _TOKENS.format("text", "term = 'licensed'"))
def get_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_columns(documents_index(spark, sf_dir).field("text").get_token("licensed"))


@_query(f"with {_TEXT} select w as word, exists(select 1 from p where term = w) as known from (values ('the'), ('licensed'), ('nosuchword')) t(w)")
def has_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = documents_index(spark, sf_dir).field("text")
    return spark.createDataFrame([(w, field.has_token(w)) for w in ("the", "licensed", "nosuchword")], "word string, known boolean")


@_query(f"with {_DOCS} select max(n)::bigint as size from (select count(*) as n from fd group by field)")
def documents_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(documents_index(spark, sf_dir).documents_size(),)], "size long")


# searches

_search("match_all_boost", {"match_all": {"boost": 2.5}}, "select doc_id as ref, 2.5::double as score from documents")
_search("terms_single", {"terms": {"text": "licensed"}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('licensed'))}")
_search("terms_multi", {"terms": {"text": {"value": ["licensed", "the", "de"]}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('licensed', 'the', 'de'))}")
_search("terms_boost", {"terms": {"text": {"value": "license", "boost": 3}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('license'), 3)}")
_search("terms_msm", {"terms": {"text": {"value": ["the", "and", "license"], "minimum_should_match": 2}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('the', 'and', 'license'))} where n >= 2")
_search("terms_expand", {"terms": {"text": {"value": "licen", "expand": True}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', "starts_with(term, 'licen')")}")
_search("terms_fuzzy", {"terms": {"p_name": {"value": "smell", "fuzziness": 1}}}, f"with {_PARTS} select ref, round(score, 6) as score from {_hits_sql('p_name', "levenshtein(term, 'smell') <= 1")}", parts_index)
_search("terms_multi_field", {"terms": {"p_name": "small", "p_type": "economy"}}, f"""with {_PARTS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('p_name', _in('small'))} union all select * from {_hits_sql('p_type', _in('economy'))}) group by 1""", parts_index, matched=True)
_search("match_or", {"match": {"text": "licensed benchmark the"}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('licensed', 'benchmark', 'the'))}")
_search("match_and", {"match": {"text": {"query": "Licensed UNDER the", "operator": "and"}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('licensed', 'under', 'the'))} where n >= 3")
_search("match_msm", {"match": {"text": {"query": "the work is licensed", "minimum_should_match": 3}}}, f"with {_TEXT} select ref, round(score, 6) as score from {_hits_sql('text', _in('the', 'work', 'is', 'licensed'))} where n >= 3")
_search("match_multi_field", {"match": {"p_name": "small red", "p_brand": "brand#2"}}, f"""with {_PARTS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('p_name', _in('small', 'red'))} union all select * from {_hits_sql('p_brand', _in('brand#2'))}) group by 1 having count(*) >= 2""", parts_index, matched=True)
_search("match_fuzzy", {"match": {"p_name": {"query": "rng blu", "fuzziness": 1}}}, f"with {_PARTS} select ref, round(score, 6) as score from {_hits_sql('p_name', "(levenshtein(term, 'rng') <= 1 or levenshtein(term, 'blu') <= 1)")}", parts_index)
_search("not_query", {"not": {"match": {"text": "licensed"}}}, f"with {_TEXT} select doc_id as ref, 1.0::double as score from documents where doc_id not in (select doc_id from p where term = 'licensed')")
_search("bool_must", {"bool": {"must": {"terms": {"text": "licensed"}}, "should": {"terms": {"lang": "en"}}}}, f"""with {_DOCS} select m.ref, round(m.score + s.score, 6) as score, 1::bigint as matched from {_hits_sql('text', _in('licensed'))} m join {_hits_sql('lang', _in('en'))} s using (ref)""", matched=True)
_search("bool_must_not", {"bool": {"must_not": {"terms": {"lang": "en"}}}}, f"with {_DOCS} select doc_id as ref, 1.0::double as score, 0::bigint as matched from documents where lower(lang) <> 'en'", matched=True)
_search("bool_filter", {"bool": {"filter": [{"terms": {"text": "licensed"}}, {"terms": {"lang": "de"}}]}}, f"""with {_DOCS} select s.ref, round(s.score, 6) as score, 0::bigint as matched from {_hits_sql('text', _in('licensed'))} m join {_hits_sql('lang', _in('de'))} s using (ref)""", matched=True)
_search("bool_should_msm", {"bool": {"should": [{"match": {"text": "the"}}, {"match": {"text": "and"}}, {"match": {"text": "license"}}], "minimum_should_match": 2}}, f"""with {_TEXT} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('text', _in('the'))} union all select * from {_hits_sql('text', _in('and'))} union all select * from {_hits_sql('text', _in('license'))}) group by 1 having count(*) >= 2""", matched=True)
_search(
    "bool_full",
    {"bool": {"must": {"match": {"text": "the"}}, "must_not": {"terms": {"source": "src1"}}, "filter": {"terms": {"lang": "en"}}, "should": [{"match": {"text": "licensed"}}, {"match": {"text": "license"}}], "minimum_should_match": 1}},
    f"""with {_DOCS}, s as (select ref, sum(score) as score, count(*)::bigint as matched from (select * from {_hits_sql('text', _in('licensed'))} union all select * from {_hits_sql('text', _in('license'))}) group by 1)
        select m.ref, round(m.score + s.score, 6) as score, s.matched from {_hits_sql('text', _in('the'))} m join s using (ref) join documents d on d.doc_id = m.ref where lower(d.lang) = 'en' and lower(d.source) <> 'src1'""",
    matched=True,
)
_search(
    "bool_nested",
    {"bool": {"must": {"bool": {"should": [{"terms": {"p_name": "small"}}, {"terms": {"p_name": "red"}}]}}, "filter": {"not": {"terms": {"p_type": "economy"}}}}},
    f"""with {_PARTS} select ref, round(sum(score), 6) as score, 0::bigint as matched from (select * from {_hits_sql('p_name', _in('small'))} union all select * from {_hits_sql('p_name', _in('red'))}) join part on p_partkey = ref where lower(p_type) <> 'economy' group by 1""",
    parts_index,
    matched=True,
)
_search("search_text_all_fields", "licensed en", f"""with {_DOCS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('text', _in('licensed', 'en'))} union all select * from {_hits_sql('lang', _in('licensed', 'en'))} union all select * from {_hits_sql('source', _in('licensed', 'en'))}) group by 1""", matched=True)
_search("search_field_boost", "licensed en", f"""with {_DOCS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('text', _in('licensed', 'en'), 2)} union all select * from {_hits_sql('lang', _in('licensed', 'en'), 0.5)}) group by 1""", matched=True, options={"fields": {"text": {"boost": 2}, "lang": {"boost": 0.5}, "source": {"boost": 0}}})
_search("search_field_map", {"p_name": "sma", "p_type": "econ"}, f"""with {_PARTS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('p_name', "starts_with(term, 'sma')")} union all select * from {_hits_sql('p_type', "starts_with(term, 'econ')")}) group by 1 having count(*) >= 2""", parts_index, matched=True, options={"expand": True, "bool": "and"})


@_query(f"with {_TEXT} select doc_id, term, round(s, 6) as score from e where regexp_matches(term, 'licen[sc]e')")
def terms_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents_index(spark, sf_dir).terms("text", [re.compile("licen[sc]e")])
    return found.select("doc_id", "term", F.round(F.col("tf") * F.pow("idf", F.lit(2)) * F.col("norm"), 6).alias("score"))


@_query("select doc_id as ref, 1.0::double as score from documents")
def match_stopwords_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index.new(ref="doc_id").add_field("text", pipeline=Pipeline([TRIMMER, STOP_WORD_FILTER])).add_documents(table(spark, sf_dir, "documents"))
    return _scored(index.search({"query": {"match": {"text": "the and of"}}}))


@_query(f"with {_TEXT} select ref, rank from (select doc_id as ref, row_number() over (order by round(max(s), 6) desc, doc_id)::int as rank from e where term in ('licensed', 'license') group by 1) where rank <= 10")
def search_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature. Ranks are the places in the search's own order."""
    best = documents_index(spark, sf_dir).search({"query": {"match": {"text": "licensed license"}}}, limit=10)
    return spark.createDataFrame([(r.ref, i + 1) for i, r in enumerate(best.select("ref").collect())], "ref long, rank int")


@_query(f"with {_TEXT} select doc_id, term, round(s, 6) as score from e where term in ('the', 'licensed') and doc_id in (select doc_id from labels where quality = 1)")
def terms_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the documents of a given set alone."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = documents_index(spark, sf_dir).terms("text", ["the", "licensed"], docs=good)
    return found.select("doc_id", "term", F.round(F.col("tf") * F.pow("idf", F.lit(2)) * F.col("norm"), 6).alias("score"))


@_query(f"with {_PARTS} select doc_id as ref, round(s, 6) as score from (select p_partkey as doc_id, 1 / sqrt(count(*) over ()) * pow(1 + log10(count(*) over () / 2), 2) as s from part) where doc_id = 7")
def match_ref_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids are a field, too."""
    return _scored(parts_index(spark, sf_dir).search({"query": {"match": {"p_partkey": 7}}}))


@_query(rf"""
    with w as (select doc_id, string_split_regex(lower(text), {_SEP}) as w from documents),
    t as (select doc_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from w),
    s as (select doc_id, token, sum(len(token) + 1) over (partition by doc_id order by i) - len(token) - 1 as start from t)
    select doc_id as ref, start::int as start, len(token)::int as len from s where token <> '' and {_TRIM.format('token')} = 'licensed'""")
def search_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents_index(spark, sf_dir).search({"query": {"match": {"text": "licensed"}}})
    return hits.select("ref", F.explode(F.col("positions")["text"]).alias("at")).select("ref", "at.start", "at.len")


@_query(rf"""
    with q as (select item_id, list_distinct(list_filter(list_transform(string_split_regex(lower(text), {_SEP}), lambda t: {_TRIM.format('t')}), lambda t: t <> '')) as terms from benchmark), {_TEXT}
    select q.item_id, e.doc_id, round(max(s), 6) as score, count(*)::bigint as held from (select item_id, unnest(terms) as term from q) q join e using (term) group by 1, 2 having count(*) >= 10""")
def match_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many match queries at once, as a join: items against all documents with ten common terms or more."""
    index = documents_index(spark, sf_dir)
    asked = Pipeline([TRIMMER]).apply(table(spark, sf_dir, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("term"))).where("term <> ''").distinct()
    found = index.match_many("text", asked, least=10)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "held")


# documents coming and going: the turns of a conversation are versions of one document


def _turns(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """All turns, in order or the last ones first."""
    turns = table(spark, sf_dir, "conversations")
    return turns.orderBy("conv_id", F.desc("turn") if last else "turn").select("conv_id", "role", "text")


def _conversations(spark: SparkSession, sf_dir: str) -> Index:
    """Of the rows that share an id the first counts."""
    index = Index.new("talk", ref="conv_id").add_field("text").add_field("role")
    return index.add_documents(_turns(spark, sf_dir))


def _talk_sql(source: str) -> str:
    return f"with s as ({source}), {_postings_sql('s', 'conv_id', {'text': False, 'role': False})} select field, doc_id, term, total from p"


def _talk(index: Index) -> DataFrame:
    return index.postings.where("field <> 'conv_id'").select("field", "doc_id", "term", "total")


_FIRST = "select conv_id, arg_min(role, turn) as role, arg_min(text, turn) as text from conversations group by 1"


@_query(_talk_sql(_FIRST))
def add_documents_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(_conversations(spark, sf_dir))


@_query(_talk_sql(_FIRST))
def add_documents_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there stays, whatever is added under its id."""
    return _talk(_conversations(spark, sf_dir).add_documents(_turns(spark, sf_dir, last=True)))


@_query(_talk_sql("select conv_id, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by 1"))
def update_documents_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(_conversations(spark, sf_dir).update_documents(_turns(spark, sf_dir, last=True)))


@_query(_talk_sql(f"select * from ({_FIRST}) where conv_id not in (select conv_id from conversations group by 1 having count(*) > 4)"))
def remove_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "conversations").groupBy("conv_id").count().where("count > 4").select("conv_id")
    return _talk(_conversations(spark, sf_dir).remove_documents(long))


@_query("""
    with s as (select event_id, lower(event_type) as t, json_extract_string(props, '$.k') as k from events)
    select field, term, count(*)::bigint as df from (select 'event_type' as field, t as term from s union all select 'props.k', k from s where k is not null) group by 1, 2""")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k string").alias("props"))
    index = Index.new(ref="event_id").add_field("event_type").add_field("props").add_documents(events)
    return index.postings.where("field <> 'event_id'").groupBy("field", "term").agg(F.count("*").alias("df"))


@_query("select p_partkey as ref, case when p_size > 25 then 'new' else p_name end as name, len(p_name)::bigint as len from part where p_size <> 7")
def docstore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"))
    store = DocumentStore().add(rows).add(part.where("p_size > 25").select(F.col("p_partkey").alias("ref"), F.lit("new").alias("name")))
    store = store.add_field_lengths(rows.select("ref", F.lit("name").alias("field"), F.length("name").alias("len"))).remove(part.where("p_size = 7").select("p_partkey"))
    return store.documents.join(store.lengths, "ref").select("ref", "source.name", "len")


def _store(spark: SparkSession) -> DiskProvider:
    """A fresh folder beside the cluster's checkpoints; in local mode without any, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    name = tempfile.mkdtemp(prefix="indexes-") if not shared else f"{shared}/indexes-{spark._jvm.java.util.UUID.randomUUID()}"
    return DiskProvider(spark, name)


@_query(f"with {_PARTS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('p_name', _in('small', 'ring'))} union all select * from {_hits_sql('p_brand', _in('small', 'ring'))} union all select * from {_hits_sql('p_type', _in('small', 'ring'))}) group by 1")
def storage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    store.write(parts_index(spark, sf_dir))
    return _scored(store.read("parts").search("small ring"), "matched")


@_query(f"with {_PARTS} select ref, round(sum(score), 6) as score, count(*)::bigint as matched from (select * from {_hits_sql('p_name', _in('small', 'ring'))} union all select * from {_hits_sql('p_brand', _in('small', 'ring'))} union all select * from {_hits_sql('p_type', _in('small', 'ring'))}) group by 1")
def storage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose documents were appended in two parts, the first with other names."""
    store, part = _store(spark), table(spark, sf_dir, "part")
    other = part.withColumn("p_name", F.lit("other small name"))
    store.write(replace(parts_index(spark, sf_dir), postings=None, field_docs=None, build=None).add_documents(other))
    store.append("parts", part.where("p_size > 25"))
    store.append("parts", part.where("p_size <= 25"))
    return _scored(store.read("parts").search("small ring"), "matched")


@_query("select 'parts' as name, 3::bigint as fields, count(*)::bigint as size from part")
def manager_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    manager = Manager(store)
    manager.save(parts_index(spark, sf_dir))
    manager.save(Index.new("other"))
    manager.remove("other")
    found = Manager(store).preload()
    sizes = [found.get(n).field_docs.where("field <> 'p_partkey'").groupBy("field").count().agg(F.lit(n).alias("name"), F.count("*").alias("fields"), F.max("count").alias("size")) for n in found.loaded_indices()]
    return sizes[0]


_LINES = [
    "settings#name:parts|ref:p_partkey|pipeline:", "db#name:index_parts|options:postings,field_docs", "field#name:p_brand|pipeline:|store_documents:true|store_positions:true",
    "field#name:p_name|pipeline:|store_documents:true|store_positions:true", "field#name:p_partkey|pipeline:identity|store_documents:false|store_positions:false", "field#name:p_type|pipeline:|store_documents:true|store_positions:true",
]


@_query("select * from (values (0::int, 'parts p_partkey 4'), " + ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(_LINES)) + ") t(line, text)")
def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of an index: what JSON holds, and its lines."""
    from .sources import serializer

    index = parts_index(spark, sf_dir)
    held = json.loads(serializer.to_json(index))
    lines = [f"{held['name']} {held['ref']} {len(held['fields'])}", *serializer.to_lines(index)]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")
