"""Where indexes are kept: a provider reads, writes, lists and deletes them by name."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index
from . import serializer


_META = "version string, settings string, has_data boolean, deltas int"


class StorageError(Exception):
    """An index can't be read, written or deleted."""


class StorageProvider(ABC):
    @abstractmethod
    def load_all(self) -> Iterator[Index]: ...

    @abstractmethod
    def read(self, name: str) -> Index: ...

    @abstractmethod
    def write(self, index: Index) -> None: ...

    @abstractmethod
    def delete(self, name: str) -> None: ...

    def append(self, name: str, docs: DataFrame, update: bool = True) -> int:
        """Adds documents to a stored index, and says how many parts of it wait to be merged by ``compact``."""
        index = self.read(name)
        self.write(index.update_documents(docs) if update else index.add_documents(docs))
        return 0

    def compact(self, name: str) -> None:
        """Merges what ``append`` has added."""
        self.write(self.read(name))


class BlackholeProvider(StorageProvider):
    """Keeps nothing."""

    def load_all(self) -> Iterator[Index]:
        return iter(())

    def read(self, name: str) -> Index:
        raise StorageError(f"can't read index {name} from blackhole")

    def write(self, index: Index) -> None:
        pass

    def delete(self, name: str) -> None:
        pass


class DiskProvider(StorageProvider):
    """A folder on any file system that Spark reaches: ``<directory>/<name>/`` with settings and Parquet tables.

    Postings are partitioned by field and sorted by term within range partitions, so that a search
    reads the row groups of its terms alone. Writing makes new versions of the tables and names
    them in the settings last, so a failed write leaves the old index. ``append`` writes the new
    documents alone, as a delta whose (field, doc_id) take the place of earlier ones when the
    index is read; ``compact`` merges deltas into a new version.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.directory, *parts)))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(path)) if self._fs(path).exists(path) else []

    def _folder(self, name: str) -> str:
        if name in ("", ".", ".."):
            raise StorageError(f"an index can't be called {name!r}")
        return re.sub(r"[^\w.-]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), name)

    def files(self) -> list[str]:
        """The paths of all stored indexes' settings."""
        return [f"{self.directory}/{n}/meta" for n in self._list() if "meta" in self._list(n)]

    def _version(self, folder: str) -> tuple[str, str, bool, int]:
        """(settings, name of the version of the tables, whether there are any, number of deltas)."""
        if "meta" not in self._list(folder):
            raise StorageError(f"there is no index {folder} in {self.directory}")
        row = self.spark.read.schema(_META).parquet(f"{self.directory}/{folder}/meta").orderBy(F.desc("version"), F.desc("deltas")).first()
        return row.settings, row.version, row.has_data, row.deltas or 0

    def _note(self, folder: str, index: Index, version: str, has_data: bool, deltas: int) -> None:
        meta = self.spark.createDataFrame([(version, serializer.to_json(index), has_data, deltas)], _META)
        meta.coalesce(1).write.mode("append").parquet(f"{self.directory}/{folder}/meta")

    def append(self, name: str, docs: DataFrame, update: bool = True) -> int:
        """Writes a delta of the documents' own postings; the stored tables are only read for the ids that are there, and not at all with ``update``."""
        folder = self._folder(name)
        index, (_, version, has_data, deltas) = self.read(name), self._version(folder)
        if not has_data:
            self.write(index.add_documents(docs))
            return 0
        new = replace(index, postings=None, field_docs=None, stats=None).add_documents(docs)
        postings, ids = new.postings, new.field_docs
        if not update:
            ids = ids.join(index.field_docs, ["field", "doc_id"], "left_anti")
            postings = postings.join(index.field_docs.select("field", "doc_id"), ["field", "doc_id"], "left_anti")
        for table, rows in (("postings", postings), ("field_docs", ids)):
            rows.write.mode("overwrite").partitionBy("field").parquet(f"{self.directory}/{folder}/{table}_{deltas + 1}-{version}")
        self._note(folder, new, version, True, deltas + 1)
        return deltas + 1

    def write(self, index: Index) -> None:
        folder = self._folder(index.name)
        root = f"{self.directory}/{folder}"
        old = int(self._version(folder)[1]) if "meta" in self._list(folder) else 0
        version = f"{old + 1:08d}"
        if index.postings is not None:
            # analysed once, into a plain table: the range partitioning samples its input, which would analyse the texts again
            index.postings.write.parquet(f"{root}/unsorted-{version}")
            ordered = self.spark.read.parquet(f"{root}/unsorted-{version}").repartitionByRange("field", "term").sortWithinPartitions("field", "term")
            ordered.write.partitionBy("field").parquet(f"{root}/postings-{version}")
            self._fs(self._path(folder)).delete(self._path(folder, f"unsorted-{version}"), True)
            index.field_docs.write.partitionBy("field").parquet(f"{root}/field_docs-{version}")
            # from the written tables, so that texts aren't analysed again
            written = replace(index, postings=self._table(f"{root}/postings-{version}"), field_docs=self._table(f"{root}/field_docs-{version}"), stats=None)
            written.field_stats().coalesce(1).write.parquet(f"{root}/field_stats-{version}")
        self._note(folder, index, version, index.postings is not None, 0)
        for entry in self._list(folder):
            if entry != "meta" and not entry.endswith(version) and int(entry.rsplit("-", 1)[1]) < int(version):
                self._fs(self._path(folder, entry)).delete(self._path(folder, entry), True)

    def read(self, name: str) -> Index:
        folder = self._folder(name)
        settings, version, has_data, deltas = self._version(folder)
        index = serializer.from_json(settings)
        if not has_data:
            return index
        names = [f"{t}-{version}" for t in ("postings", "field_docs", "field_stats")]
        added = [(f"postings_{k}-{version}", f"field_docs_{k}-{version}") for k in range(1, deltas + 1)]
        if missing := {*names, *(n for pair in added for n in pair)} - set(self._list(folder)):
            raise StorageError(f"index {name} lacks {', '.join(sorted(missing))}")

        root = f"{self.directory}/{folder}"
        postings, ids = self._table(f"{root}/{names[0]}"), self._table(f"{root}/{names[1]}")
        if not added:
            return replace(index, postings=postings, field_docs=ids, stats=self.spark.read.parquet(f"{root}/{names[2]}"))
        tables = [(postings, ids), *((self._table(f"{root}/{p}", postings), self._table(f"{root}/{i}", ids)) for p, i in added)]
        # from the last one on: what a later table holds takes the place of earlier rows
        *earlier, (postings, ids) = tables
        for older, older_ids in reversed(earlier):
            later = ids.select("field", "doc_id")
            postings = postings.unionByName(older.join(later, ["field", "doc_id"], "left_anti"))
            ids = ids.unionByName(older_ids.join(later, ["field", "doc_id"], "left_anti"))
        return replace(index, postings=postings, field_docs=ids)

    def _table(self, path: str, like: DataFrame | None = None) -> DataFrame:
        """A stored table; an empty one, without partitions to tell its columns from, has those of ``like``."""
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(path).withColumn("field", F.col("field").cast("string"))

    def load_all(self) -> Iterator[Index]:
        for path in self.files():
            yield self.read(serializer.from_json(self._version(path.split("/")[-2])[0]).name)

    def delete(self, name: str) -> None:
        folder = self._folder(name)
        if "meta" not in self._list(folder):
            raise StorageError(f"there is no index {name} in {self.directory}")
        self._fs(self._path(folder)).delete(self._path(folder), True)
