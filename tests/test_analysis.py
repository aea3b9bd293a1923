"""Tokens, runners, pipelines and stems; the Python and the column side agree."""

import pytest
from pyspark.sql import functions as F

from quernel import Pipeline, default_runners
from quernel.functions.analysis import IDENTITY, STEMMER, STOP_WORD_FILTER, STOP_WORDS, TRIMMER, levenshtein, tokenize, tokens, trim, trim_column
from quernel.functions.stem import stem
from quernel.queries import STEMS


def test_tokens_and_places():
    assert [(t.token, t.start, t.len) for t in tokenize("the man came home")] == [("the", 0, 3), ("man", 4, 3), ("came", 8, 4), ("home", 13, 4)]
    assert [t.token for t in tokenize("  FOO    BAR   ")] == ["foo", "bar"]
    assert [t.token for t in tokenize("New York-San Francisco")] == ["new", "york", "san", "francisco"]
    assert [t.token for t in tokenize("a/b/%%%c%d", "[/%]")] == ["a", "b", "c", "d"]
    assert [t.token for t in tokenize(-5)] == ["5"] and tokenize(None) == [] and tokenize("") == []


def test_columns_agree_with_python(spark):
    texts = ["The quick-fox", "", " ", "Él  niño\tÀ\n\nz", "word " * 500, None, "a" * 300, "x-y--z "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in rows.select("i", tokens(F.col("t")).alias("x")).collect()}
    assert {i: [tuple(x) for x in v or []] for i, v in got.items()} == {i: [(t.token, t.start, t.len) for t in tokenize(x)] for i, x in enumerate(texts)}
    cases = {"hello.": "hello", "it's": "it's", "james'": "james", "stop!'": "stop", "": "", "[tag]": "tag", "[[!@#@!hello]]]}}}": "hello", "~!@@@hello***()()()]]": "hello"}
    assert [trim(k) for k in cases] == list(cases.values())
    column = spark.createDataFrame([(k,) for k in cases], "t string").select(trim_column(F.col("t"))).collect()
    assert [r[0] for r in column] == list(cases.values())


def test_stems_and_stop_words(spark):
    assert [(w, stem(w)) for s, ws in STEMS.items() for w in ws.split() if stem(w) != s] == []
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 119
    pipeline = Pipeline(default_runners())
    assert [t.token for t in pipeline.run("the consignment, but worlds. than")] == ["consign", "world"]
    rows = spark.createDataFrame([("the",), ("consignment,",), ("worlds",), (None,)], "term string")
    assert [r.term for r in pipeline.apply(rows).collect()] == ["consign", "world"]


def test_editing_pipelines():
    p = Pipeline([TRIMMER, STEMMER, TRIMMER])
    assert p.names == ["trimmer", "stemmer"]
    assert p.add(STOP_WORD_FILTER).names == ["stop_word_filter", "trimmer", "stemmer"] and p.add(TRIMMER) == p
    assert p.insert_before(STEMMER, STOP_WORD_FILTER).names == p.insert_after(TRIMMER, STOP_WORD_FILTER).names == ["trimmer", "stop_word_filter", "stemmer"]
    assert p.insert_after(IDENTITY, STOP_WORD_FILTER).names == ["stop_word_filter", "trimmer", "stemmer"]
    assert p.remove(TRIMMER).names == ["stemmer"] and p.remove(IDENTITY) == p


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("", "ab", 2), ("Flaw", "lawn", 2), ("café", "cafe", 1), ("", "", 0)])
def test_edit_distance(a, b, n):
    assert levenshtein(a, b) == n
