"""Documents coming and going, storage, the catalog, settings, streams."""

import pytest
from pyspark.sql import functions as F

from quernel import BlackholeProvider, DiskProvider, DocumentStore, Index, Manager, Pipeline, default_runners
from quernel.sources import serializer
from quernel.sources.manager import AlreadyExists, NotLoaded
from quernel.sources.storage import StorageError
from quernel.streaming.ingest import ingest


def people(spark, *rows):
    return spark.createDataFrame(rows, "id long, bio string")


def ids(df):
    return sorted(r[0] for r in df.collect())


def terms(index, field="bio"):
    return sorted(r.term for r in index.field(field).distinct_terms().collect())


def test_adding_updating_removing(spark):
    index = Index.new().add_field("bio").add_documents(people(spark, (10, "this is a test"), (30, "this is another test"), (30, "second"), (None, "lost")))
    assert index.documents_size() == 2 and index.field("bio").get_token("test").first().idf > 0
    again = index.add_documents(people(spark, (10, "other words"), (40, "new")))
    assert ids(again.field("bio").documents()) == [10, 30, 40] and "other" not in terms(again)
    changed = again.update_documents(people(spark, (10, "bar"), (50, "more")))
    assert ids(changed.search("bar").select("ref")) == [10] and ids(changed.field("bio").documents()) == [10, 30, 40, 50]
    assert changed.search("a").isEmpty()
    less = changed.remove_documents([10, 999])
    assert ids(less.field("bio").documents()) == [30, 40, 50] and "bar" not in terms(less) and less.documents_size() == 3
    assert ids(less.all()) == [30, 40, 50]


def test_values_of_all_kinds(spark):
    rows = spark.createDataFrame([(1, "", 5, True, ["New York", "x"], 1.5), (2, None, -5, False, None, None)], "id long, bio string, n int, flag boolean, tags array<string>, x double")
    index = Index.new()
    for f in ("bio", "n", "flag", "tags", "x"):
        index = index.add_field(f)
    index = index.add_documents(rows)
    # an empty text counts its document, with no terms; null and false count none
    assert ids(index.field("bio").documents()) == [1] and terms(index) == []
    assert index.field_stats().where("field = 'bio'").first().norm == 0
    assert terms(index, "n") == ["5"] and terms(index, "flag") == ["true"] and terms(index, "tags") == ["New York", "x"] and terms(index, "x") == ["1.5"]
    assert ids(index.search({"query": {"terms": {"tags": "New York"}}}).select("ref")) == [1]
    assert Index.new().add_field("bio").add_documents(people(spark).where("false")).search("x").isEmpty()
    with pytest.raises(ValueError):
        Index.new(ref="key").add_documents(rows)


def test_nested_documents(spark):
    schema = "id long, name string, address struct<city:string,place:struct<land:string>>, props map<string,string>"
    rows = spark.createDataFrame([(1, "jason mount", ("Boston", ("USA",)), {"a": "red"}), (2, "peters book", ("Murry Street", ("CA",)), {"b": "blue"})], schema)
    index = Index.new().add_field("name").add_field("address").add_field("props.a").add_documents(rows)
    assert set(index.get_fields()) == {"id", "name", "address", "address.city", "address.place.land", "props.a"}
    assert ids(index.search("jason murry").select("ref")) == [1, 2]
    assert ids(index.search({"query": {"match": {"address.place.land": "usa"}}}).select("ref")) == [1]
    assert ids(index.search({"query": {"match": {"props.a": "red"}}}).select("ref")) == [1]


def test_fields(spark):
    index = Index.new(pipeline=Pipeline(default_runners())).add_field("bio")
    assert index.get_fields() == ["id", "bio"] and index.get_field("bio").pipeline.names == ["trimmer", "stop_word_filter", "stemmer"]
    assert index.update_field("bio", pipeline=Pipeline()).get_field("bio").pipeline.names == []
    assert not index.save_document(False).get_field("bio").store_documents
    for call in (lambda: index.update_field("x", store_positions=False), lambda: index.get_field("x"), lambda: index.analyze("x", "a")):
        with pytest.raises(ValueError, match="Unknown field x"):
            call()
    assert [t.token for t in index.analyze("bio", "the worlds")] == ["world"]


def test_disk_and_manager(spark, tmp_path):
    disk = DiskProvider(spark, str(tmp_path / "store"))
    index = Index.new(name="people/1", pipeline=Pipeline(default_runners())).add_field("bio", query_pipeline=Pipeline()).add_documents(people(spark, (1, "red houses"), (2, "blue house")))
    assert disk.files() == []
    with pytest.raises(StorageError):
        disk.read("people/1")
    with pytest.raises(StorageError):
        disk.delete("people/1")
    manager = Manager(disk)
    assert manager.save(index) is index and manager.loaded_indices() == ["people/1"] and len(disk.files()) == 1
    with pytest.raises(AlreadyExists):
        manager.save(index)
    back = Manager(disk).preload().get("people/1")
    assert back.fields == index.fields and back.pipeline == index.pipeline
    show = lambda i: [(r.ref, round(r.score, 9), r.positions) for r in i.search("hous").collect()]
    assert show(back) == show(index) and len(show(back)) == 2
    manager.update(back.update_documents(people(spark, (2, "green"))))
    assert [r[0] for r in show(disk.read("people/1"))] == [1]
    with pytest.raises(NotLoaded):
        Manager(disk).update(index)
    manager.remove("people/1")
    assert disk.files() == [] and not manager.loaded("people/1")
    with pytest.raises(NotLoaded):
        manager.remove("people/1")
    with pytest.raises(NotLoaded):
        manager.get("unknown")
    disk.write(Index.new(name="empty"))
    assert disk.read("empty").postings is None and [i.name for i in disk.load_all()] == ["empty"]


def test_blackhole():
    nowhere = BlackholeProvider()
    nowhere.write(Index.new())
    nowhere.delete("x")
    assert list(nowhere.load_all()) == []
    with pytest.raises(StorageError, match="blackhole"):
        nowhere.read("x")
    assert Manager().save(Index.new(name="a")).name == "a"


def test_settings_lines():
    index = Index.new(name="a#b|c", pipeline=Pipeline(default_runners())).add_field("body").add_field("x", pipeline=Pipeline(), store_positions=False)
    lines = serializer.to_lines(index)
    assert lines[0] == "settings#name:a%23b%7Cc|ref:id|pipeline:trimmer,stop_word_filter,stemmer"
    assert lines[3:] == ["field#name:id|pipeline:identity|store_documents:false|store_positions:false", "field#name:x|pipeline:|store_documents:true|store_positions:false"]
    back = serializer.from_lines([*lines, "else#a:b"])
    assert back.fields == index.fields and (back.name, back.ref, back.pipeline) == (index.name, index.ref, index.pipeline)
    assert serializer.from_json(serializer.to_json(index)).fields == index.fields
    with pytest.raises(ValueError):
        serializer.from_lines(["db#name:x"])


def test_document_store(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "ref long, name string")
    store = DocumentStore()
    assert store.length == 0 and store.save and not store.exists(1) and store.add_field_length(spark, 1, "name", 3) is store
    store = store.add(docs((1, "a"), (2, "b"))).add(docs((1, "c")))
    assert store.length == 2 and store.get(1).first().source.name == "c" and store.exists(2) and not store.exists(9) and store.get(9).isEmpty()
    store = store.add_field_length(spark, 1, "name", 20).add_field_length(spark, 9, "name", 5)
    assert store.field_length(1, "name") == 20 and store.field_length(9, "name") is None and store.field_length(2, "name") is None
    assert store.update_field_length(spark, 1, "name", 7).field_length(1, "name") == 7
    less = store.remove(docs((1, "")).select("ref"))
    assert less.length == 1 and less.field_length(1, "name") is None
    assert store.reset().length == 0
    assert DocumentStore(save=False).add(docs((1, "a"))).get(1).first().source is None


def test_stream(spark, tmp_path):
    disk = DiskProvider(spark, str(tmp_path / "store"))
    disk.write(Index.new(name="live").add_field("bio").add_documents(people(spark, (1, "old"))))
    people(spark, (1, "new"), (2, "two")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, bio string").parquet(str(tmp_path / "in"))
    ingest(stream, disk, "live", str(tmp_path / "cp")).awaitTermination()
    index = disk.read("live")
    assert ids(index.all()) == [1, 2] and terms(index) == ["new", "two"]
    assert index.postings.where(F.col("term") == "old").isEmpty()


@pytest.mark.parametrize("update", [True, False])
def test_deltas_and_their_merging(spark, tmp_path, update):
    disk = DiskProvider(spark, str(tmp_path / "store"))
    plain = Index.new(name="live").add_field("bio").add_documents(people(spark, (1, "one red"), (2, "two")))
    disk.write(plain)
    batches = [people(spark, (1, "blue"), (3, "three red")), people(spark, (3, "green"), (3, "twice"), (4, "")), people(spark, (9, "x")).where("false"), people(spark, (1, "grey red"))]
    show = lambda i: sorted((r.ref, round(r.score, 9)) for r in i.search("red grey twice").collect())
    for k, docs in enumerate(batches):
        assert disk.append("live", docs, update) == k + 1
        plain = plain.update_documents(docs) if update else plain.add_documents(docs)
        stored = disk.read("live")
        assert ids(stored.all()) == ids(plain.all()) and terms(stored) == terms(plain) and show(stored) == show(plain)
    disk.compact("live")
    stored = disk.read("live")
    assert stored.stats is not None and show(stored) == show(plain) and terms(stored) == terms(plain)
    assert sorted(disk._list("live")) == ["field_docs-00000002", "field_stats-00000002", "meta", "postings-00000002"]


def test_stream_in_several_batches(spark, tmp_path):
    disk = DiskProvider(spark, str(tmp_path / "store"))
    disk.write(Index.new(name="live").add_field("bio"))
    for i in range(5):
        people(spark, (i, f"word{i}"), (100, f"last{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, bio string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, disk, "live", str(tmp_path / "cp"), compact_every=3).awaitTermination()
    index = disk.read("live")
    assert ids(index.all()) == [0, 1, 2, 3, 4, 100] and len([t for t in terms(index) if t.startswith("last")]) == 1
