"""Query results with absolute scores: five documents, 119 distinct terms."""

import pytest

from quernel import Index, Pipeline, default_runners
from quernel.functions.analysis import python_runner
from quernel.plans import dsl

FILLER = [f"w{i}" for i in range(80)]
CORPUS = [
    (1, "The quick fox jumped over the lazy dog"),
    (2, "Lorem ipsum sit amet sit elit sit " + " ".join(FILLER[:60])),
    (3, "Lorem dog"),
    (4, "livebook is elm's own. it's very good"),
    (5, "lots of help with the elm project, livebook, " + " ".join(FILLER[60:])),
]
TERMS = {w for _, t in CORPUS for w in t.lower().split()}
FOX, LOREM = 0.179144544957, 0.136855235636


@pytest.fixture(scope="module")
def index(spark):
    missing = 119 - len(TERMS)
    rows = [(i, t + "".join(f" x{k}" for k in range(missing)) if i == 2 else t) for i, t in CORPUS]
    built = Index.new(name="tests").add_field("content").add_documents(spark.createDataFrame(rows, "id long, content string"))
    cached = built.postings.cache(), built.field_docs.cache()
    yield Index(built.name, built.ref, built.pipeline, built.fields, *cached)
    [c.unpersist() for c in cached]


def hits(index, query, **options):
    return {r.ref: (round(r.score, 9), r.matched) for r in index.search({"query": query} if isinstance(query, dict) else query, **options).collect()}


def scores(index, query):
    return {ref: s for ref, (s, _) in hits(index, query).items()}


def near(expected):
    return {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}


def test_statistics(index):
    stats = {r.field: (r.n_docs, r.n_terms, r.norm) for r in index.field_stats().collect()}
    assert stats["content"] == (5, 119, pytest.approx(0.091669849702821))
    assert stats["id"][:2] == (5, 5)
    field = index.field("content")
    assert field.has_token("fox") and not field.has_token("cat")
    assert [(r.doc_id, r.tf) for r in field.term_frequency("sit").collect()] == [(2, pytest.approx(3**0.5))]
    assert field.length() == 5 and field.length("term", "lorem") == 2 and field.length("tf", "lorem") == 2 and field.length("idf", "lorem") == 1 and field.length("idf", "cat") == 0
    token = field.get_token("lorem").first()
    assert (token.tf, token.documents) == (2, [2, 3]) and token.idf == pytest.approx(1.221848749616)
    assert field.get_token("cat").isEmpty()
    assert field.tokens().count() == field.distinct_terms().count() == 119
    assert index.documents_size() == 5 and index.all().count() == 5


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"match_all": {}}, dict.fromkeys(range(1, 6), 1.0)),
        ({"match_all": {"boost": 2.5}}, dict.fromkeys(range(1, 6), 2.5)),
        ({"terms": {"content": "fox"}}, {1: FOX}),
        ({"terms": {"content": ["fox", "lorem"]}}, {1: FOX, 2: LOREM, 3: LOREM}),
        ({"terms": {"content": "the"}}, {1: 0.193542530319, 5: LOREM}),
        ({"terms": {"content": "sit"}}, {2: 0.310287453765}),
        ({"terms": {"content": "Fox"}}, {}),
        ({"terms": {}}, dict.fromkeys(range(1, 6), 1.0)),
        ({"terms": {"content": {"value": ["lorem"], "boost": 2}}}, {2: 2 * LOREM, 3: 2 * LOREM}),
        ({"terms": {"content": {"value": "livebook", "expand": True}}}, {4: FOX, 5: FOX}),
        ({"terms": {"content": {"value": "foz", "fuzziness": 1}}}, {1: FOX}),
        ({"terms": {"content": {"value": ["lorem", "dog"], "minimum_should_match": 2}}}, {3: LOREM}),
        ({"match": {"content": "brown fox"}}, {1: FOX}),
        ({"match": {"content": {"query": "fox quick", "operator": "and"}}}, {1: FOX}),
        ({"match": {"content": {"query": "fox lorem", "operator": "and"}}}, {}),
        ({"match": {"content": {"query": "fox", "boost": 3}}}, {1: 3 * FOX}),
        ({"match": {"content": {"query": ""}}}, dict.fromkeys(range(1, 6), 1.0)),
        ({"match": {"content": "fox", "id": 1}}, {1: pytest.approx}),
        ({"match": {"id": 3}}, {3: pytest.approx}),
        ({"not": {"bool": {"should": [{"terms": {"content": "quick"}}, {"terms": {"content": "lorem"}}]}}}, {4: 1.0, 5: 1.0}),
        ({"bool": {}}, {}),
        ({"bool": {"must_not": {"terms": {"content": "lorem"}}}}, {1: 1.0, 4: 1.0, 5: 1.0}),
        ({"bool": {"filter": {"terms": {"content": "lorem"}}}}, {2: LOREM, 3: LOREM}),
        ({"bool": {"must": {"terms": {"content": "lorem"}}, "must_not": {"terms": {"content": "ipsum"}}, "should": {"terms": {"content": "dog"}}}}, {3: 2 * LOREM}),
        ({"bool": {"must": {"match_all": {}}, "filter": {"terms": {"content": "lorem"}}}}, {2: 1.0, 3: 1.0}),
        ({"bool": {"filter": [{"terms": {"content": "lorem"}}, {"not": {"terms": {"content": "dog"}}}]}}, {2: 1.0}),
        ({"bool": {"must": {"terms": {"content": "lorem"}}, "filter": {"terms": {"content": "dog"}}, "should": {"match_all": {}}}}, {3: LOREM + 1}),
        ({"bool": {"should": [{"terms": {"content": {"value": "fox", "boost": 0}}}]}}, {}),
    ],
)
def test_queries(index, query, expected):
    got = scores(index, query)
    if any(v is pytest.approx for v in expected.values()):
        assert set(got) == set(expected)
    else:
        assert got == near(expected)


def test_should_clauses_add_up(index):
    should = [{"match": {"content": "quick"}}, {"match": {"content": "dog"}}]
    assert hits(index, {"bool": {"should": should}}) == {1: (pytest.approx(0.315999780594), 2), 3: (pytest.approx(LOREM), 1)}
    assert hits(index, {"bool": {"should": should, "minimum_should_match": 2}}) == {1: (pytest.approx(0.315999780594), 2)}
    assert hits(index, {"bool": {"should": should, "minimum_should_match": "100%"}}).keys() == {1}
    # more than there are clauses: the default counts
    assert hits(index, {"bool": {"should": should, "minimum_should_match": 9}}).keys() == {1, 3}
    must = {"terms": {"content": "lorem"}}
    assert hits(index, {"bool": {"must": must, "should": [{"terms": {"content": "dog"}}]}}) == {3: (pytest.approx(2 * LOREM), 1)}
    assert hits(index, {"bool": {"must": must, "should": [{"terms": {"content": "dog"}}], "minimum_should_match": 0}}).keys() == {2, 3}


def test_positions(index):
    first = index.search({"query": {"match": {"content": "fox quick"}}}).first()
    assert [tuple(p) for p in first.positions["content"]] == [(10, 3)]
    row = index.search({"query": {"bool": {"must": {"terms": {"content": "lorem"}}, "should": [{"terms": {"content": "dog"}}]}}}).first()
    assert {k: [tuple(p) for p in v] for k, v in row.positions.items()} == {"content": [(6, 3)]}
    row = index.search({"query": {"bool": {"should": [{"terms": {"content": "the"}}, {"terms": {"content": "dog"}}]}}}).first()
    assert [tuple(p) for p in row.positions["content"]] == [(0, 3), (26, 3), (35, 3)]


def test_entry_points(index):
    assert hits(index, None) == {}
    assert scores(index, "me") == {}
    assert scores(index, "fox") == near({1: FOX})
    assert {r.ref: round(r.score, 9) for r in index.search("fox", {"fields": {"content": {"boost": 2}}}).collect()} == near({1: 2 * FOX})
    assert index.search("fox", {"fields": {"content": {"boost": 0}}}).isEmpty()
    assert {r.ref for r in index.search({"content": "live"}, {"expand": True}).collect()} == {4, 5}
    assert {r.ref for r in index.search({"content": "lorem dog"}, {"bool": "and"}).collect()} == {3}
    assert [r.ref for r in index.search("lorem dog").collect()] == [1, 2, 3]
    assert [r.ref for r in index.search("lorem dog", limit=1).collect()] == [1]


@pytest.mark.parametrize(
    "query",
    [
        {"query": {"nope": {}}},
        {"query": {"match": {}, "terms": {}}},
        {"wrong": "x"},
        {},
        {"query": {"match": {"unknown": "x"}}},
        {"query": {"terms": {"unknown": "x"}}},
        {"query": {"bool": {"should": ["x"]}}},
        {"query": {"bool": {"should": {"match_all": {}}, "minimum_should_match": 1.5}}},
        {"query": {"terms": {"content": {"boost": 2}}}},
    ],
)
def test_wrong_queries(index, query):
    with pytest.raises(ValueError):
        index.search(query)


def test_parsing():
    assert dsl.parse({"terms": {"name": "kim"}}) == dsl.Terms("name", ["kim"])
    assert dsl.parse({"terms": {"name": {"value": "kim"}}}) == dsl.Terms("name", ["kim"])
    both = dsl.parse({"terms": {"name": "kim", "land": "us", "boost": 4}})
    assert both == dsl.Bool(should=[dsl.Terms("name", ["kim"]), dsl.Terms("land", ["us"])], minimum_should_match=1)
    many = dsl.parse({"match": {"name": "kim", "land": "us"}})
    assert many == dsl.Bool(should=[dsl.Match("name", "kim"), dsl.Match("land", "us")], minimum_should_match=2)
    whole = dsl.parse({"bool": {"must": {"terms": {"a": 1}}, "must_not": {"terms": {"b": 2}}, "filter": {"match": {"c": 3}}, "should": {"match": {"d": 4}}}})
    assert whole == dsl.Bool(dsl.Terms("a", [1]), dsl.Terms("b", [2]), [dsl.Match("c", 3)], [dsl.Match("d", 4)], 0)
    assert dsl.parse({"match_all": {"boost": 2.5}}) == dsl.MatchAll(2.5)
    assert dsl.parse({"not": {"match": {"a": "x"}}}) == dsl.Not(dsl.Match("a", "x"))


def test_regular_expressions_and_entries(index):
    import re

    field = index.field("content")
    assert {r.doc_id for r in field.terms([re.compile("^live")]).collect()} == {4, 5}
    assert {r.doc_id for r in field.terms(["fxo"], fuzziness=2).collect()} >= {1}
    assert field.terms(["missing"]).isEmpty()
    assert {r.doc_id for r in field.terms(["lorem", "dog"], minimum_should_match=2).collect()} == {3}
    wanted = index.all().where("doc_id = 3")
    assert {r.doc_id for r in field.terms(["lorem"], docs=wanted).collect()} == {3}


def test_query_pipeline(spark):
    widen = python_runner("test_widen", lambda t: ["bar", "baz", "barry", "foo"] if t == "foo" else t)
    rows = spark.createDataFrame([("a", "Barry had a beer with Fred in the bar"), ("b", "the bar is empty")], "id string, info string")
    index = Index.new().add_field("info", query_pipeline=Pipeline([widen])).add_documents(rows)
    found = index.search("foo").collect()
    assert [r.ref for r in found] == ["a", "b"] and found[0].score > found[1].score


def test_stems_in_a_search(spark):
    rows = spark.createDataFrame([(1, "the consigned worlds."), (2, "nothing")], "id long, text string")
    index = Index.new(pipeline=Pipeline(default_runners())).add_field("text").add_documents(rows)
    assert [r.ref for r in index.search("consigning world").collect()] == [1]
    assert {r.term for r in index.field("text").distinct_terms().collect()} == {"consign", "world", "noth"}
    row = index.search("consigning").first()
    assert [tuple(p) for p in row.positions["text"]] == [(4, 9)]


def test_clauses_share_their_scans(spark, tmp_path):
    """However many clauses a query has, postings are read once for the terms and once for the norms, ids once or twice."""
    spark.createDataFrame([(1, "red fox", "en"), (2, "blue fox", "de"), (3, "red dog", "en")], "id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    index = Index.new().add_field("text").add_field("lang").add_documents(spark.read.parquet(str(tmp_path / "docs")))
    query = {"bool": {"must": {"match": {"text": "fox"}}, "must_not": {"terms": {"lang": "fr"}}, "filter": {"terms": {"lang": ["en", "de"]}}, "should": [{"match": {"text": "red"}}, {"match": {"text": "blue"}}, {"not": {"match": {"text": "dog"}}}]}}
    found = index.search({"query": query})
    scans = found._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans <= 4
    assert {r.ref: r.matched for r in found.collect()} == {1: 2, 2: 2}
    both = {"bool": {"must_not": query, "should": [{"match_all": {"boost": 2}}]}}
    assert {r.ref: (round(r.score, 6), r.matched) for r in index.search({"query": both}).collect()} == {3: (3.0, 1)}


def test_flags_of_patterns(spark):
    import re

    index = Index.new().add_field("text").add_documents(spark.createDataFrame([(1, "red\nRED été"), (2, "ered")], "id long, text string"))
    found = lambda p: sorted((r.doc_id, r.term) for r in index.terms("text", [p]).collect())
    assert found(re.compile("^RE D$", re.I | re.X)) == [(1, "red")] and found(re.compile(r"^\w+é$")) == [(1, "été")] and found(re.compile(r"^\w+é$", re.A)) == []
    with pytest.raises(ValueError):
        index.terms("text", [re.compile("red", re.DEBUG)])
