"""Texts analysed a batch at a time: the same postings as word by word, and no shuffle of a document's words."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quernel import Index, Pipeline, default_runners, queries
from quernel.functions import batches
from quernel.functions.analysis import STEMMER, TRIMMER, Runner, python_runner, tokenize

TEXTS = ["The quick-fox", "", " - ", "Él  niño\tÀ!\n\nz", "word " * 50, "a" * 300, "x-y--z x", "((été)) (the) the", "--", "running runs. ran\r\nthe", " end 漢字 end", "tail-"]


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
@pytest.mark.parametrize("pipeline", [Pipeline(), Pipeline([TRIMMER]), Pipeline(default_runners())], ids=["plain", "trimmed", "default"])
def test_postings_of_chunks(monkeypatch, chunk, pipeline):
    monkeypatch.setattr(batches, "CHUNK", chunk)
    got = {}
    for at, text in batches._slices(pa.array([t.lower() for t in TEXTS])[0:]):
        words = batches._cut(text, tuple(pipeline.names), None)
        key, begin, order = batches._grouped(words)
        places = batches._placed(words, order).to_pylist()
        for i, k in enumerate(key):
            row, code = divmod(int(k), len(words.terms))
            got[row + at, words.terms[code].as_py()] = [(p["start"], p["len"]) for p in places[begin[i] : begin[i + 1]]]
    expected = defaultdict(list)
    for i, t in enumerate(TEXTS):
        for token in pipeline.run(t):
            expected[i, token.token].append(token.position)
    assert got == expected


def test_the_same_as_word_by_word(spark):
    rows = [(f"d{i}", t, i % 3 == 0 or None, -i, [t, None] if i % 2 else None) for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame([*rows, (None, "lost", True, 1, None)], "id string, text string, flag boolean, n int, tags array<string>")
    word_by_word = python_runner("test_same", lambda t: t)

    def built(*more):
        index = Index.new().add_field("text", pipeline=Pipeline([*default_runners(), *more])).add_field("flag", pipeline=Pipeline(more)).add_field("n", pipeline=Pipeline(more), store_positions=False).add_field("tags", pipeline=Pipeline([TRIMMER, *more]))
        return index.add_documents(docs)

    everything = lambda index: Counter((r.field, r.doc_id, r.term, r.total, tuple(map(tuple, r.positions))) for r in index.postings.collect())
    fast, slow = built(), built(word_by_word)
    assert everything(fast) == everything(slow) and {r.field for r in fast.field_docs.collect()} == {"id", "text", "flag", "n", "tags"}
    stats = lambda df: sorted(map(tuple, df.collect()))
    assert stats(fast.field_stats()) == stats(slow.field_stats()) and stats(fast.term_stats()) == stats(slow.term_stats())
    for query in ({"terms": {"text": {"value": ["run", "ru"], "expand": True}}}, {"terms": {"text": ["run", "x", "nope"]}}, {"bool": {"must": {"match": {"text": "running"}}, "should": {"terms": {"tags": {"value": "RUNN", "expand": True}}}, "minimum_should_match": 0}}):
        assert stats(fast.search({"query": query}).select("ref", "score")) == stats(slow.search({"query": query}).select("ref", "score"))
    row = fast.field("text").get_token("run").first()
    assert (row.tf, row.documents) == (1, ["d9"])


def test_runners_of_the_same_name_are_not_mistaken(spark):
    """Runners are equal by name, but only the library's own may be replaced by what they do to arrays."""
    other = Runner("stemmer", lambda t: t, lambda t: t)
    assert batches.fits(Pipeline([STEMMER])) and not batches.fits(Pipeline([other])) and not batches.fits(Pipeline([], separator="[/]"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SF = "/root/testdata/sf0.001"
#: Queries over documents that the findings name but for search_top_k, which has ranks of its own search.
NAMED = (
    "bool_must search_positions terms_in_documents match_benchmark_items terms_multi pipeline_default match_or not_query match_msm bool_filter "
    "document_frequency bool_full terms_single match_and terms_msm bool_should_msm search_field_boost search_text_all_fields terms_expand"
).split()


@pytest.mark.parametrize("name", ["search_top_k", *NAMED])
def test_words_are_not_shuffled(spark, name):
    """Words go from the scan to a document's postings without an exchange, so no shuffle has a row for each word."""
    found = queries.documents_index(spark, SF).search({"query": {"match": {"text": "licensed license"}}}, limit=10) if name == "search_top_k" else queries.QUERIES[name](spark, SF)
    plan = _plan(found)
    assert "MapInArrow" in plan
    assert not re.search(r"hashpartitioning\([^)]*doc_id[^)]*term", plan) and "explode" not in plan.replace("explode(positions", "")


def test_rows_that_share_an_id_are_one_document(spark, tmp_path):
    rows = [(1, "red fox"), (1, "red dog"), (2, "blue"), (None, "blue blue"), (None, "blue"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = Counter((i, t.token) for i, text in rows for t in tokenize(text))
    for name in ("tokenize_text", "pipeline_default"):
        assert {(r.doc_id, r.term): r.n for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == expected


@pytest.mark.parametrize("pairs", [2, 1_000_000])
def test_many_items_against_plain_loops(spark, monkeypatch, pairs):
    monkeypatch.setattr(batches, "PASS_PAIRS", pairs)
    texts = {1: "red fox red", 2: "blue fox (dog)", 3: "", 4: "green", 5: "red blue fox dog"}
    items = {"a": {"red", "fox"}, "b": {"fox", "dog", "blue"}, "c": {"nope"}, None: {"green", "red"}}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = Index.new().add_field("text", pipeline=Pipeline([TRIMMER])).add_documents(docs)
    asked = spark.createDataFrame([(i, t) for i, ts in items.items() for t in ts], "item_id string, term string")
    held = {d: Counter(t.token for t in Pipeline([TRIMMER]).run(text)) for d, text in texts.items()}
    df = Counter(t for ts in held.values() for t in ts)
    score = lambda d, t: math.sqrt(held[d][t]) * (1 + math.log10(len(texts) / (df[t] + 1))) ** 2 / math.sqrt(len(df))
    for least in (1, 2):
        expected = {(i, d): (pytest.approx(max(score(d, t) for t in ts & held[d].keys())), len(ts & held[d].keys())) for i, ts in items.items() for d in texts if len(ts & held[d].keys()) >= least}
        for own in (index, Index(index.name, index.ref, index.pipeline, index.fields, index.postings, index.field_docs)):
            assert {(r.item_id, r.doc_id): (r.score, r.held) for r in own.match_many("text", asked, least).collect()} == expected
    empty = Index.new().add_field("text").add_documents(docs.where("false"))
    assert empty.match_many("text", asked).isEmpty()
