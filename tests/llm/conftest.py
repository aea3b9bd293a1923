import pytest


@pytest.fixture
def rows(spark):
    """(id, text) -> documents with other columns whose names clash with the operators' own."""

    def make(*pairs, schema="doc_id long, text string"):
        full = [(*p, "x", 1, 2, "y") for p in pairs]
        return spark.createDataFrame(full, schema + ", score string, part int, slot long, label string")

    return make


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    """Small tables need few hash ranges."""
    from quernel.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LEAST_RANGES", 4)
