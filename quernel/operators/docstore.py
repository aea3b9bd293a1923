"""A keyed store of documents with the lengths of their fields."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DocumentStore:
    """``documents`` (ref, source) and ``lengths`` (ref, field, len); every change gives a new store.

    Without ``save`` only refs and lengths are kept and sources are null.
    """

    documents: DataFrame | None = None
    lengths: DataFrame | None = None
    save: bool = True

    def add(self, docs: DataFrame, ref: str = "ref") -> DocumentStore:
        """Adds or replaces documents: rows with an id in ``ref``; of rows that share one, any."""
        own = docs.where(F.col(ref).isNotNull()).dropDuplicates([ref])
        source = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        new = own.select(F.col(ref).alias("ref"), source.alias("source") if self.save else F.lit(None).cast(own.select(source.alias("s")).schema["s"].dataType).alias("source"))
        kept = None if self.documents is None else self.documents.join(new.select("ref"), "ref", "left_anti")
        return replace(self, documents=new if kept is None else kept.unionByName(new))

    def get(self, ref) -> DataFrame:
        """The document's row (ref, source), or none."""
        return self._documents().where(F.col("ref") == F.lit(ref))

    def exists(self, ref) -> bool:
        return self.documents is not None and not self.get(ref).isEmpty()

    def remove(self, refs: DataFrame) -> DocumentStore:
        """Without the documents of these refs (first column) and their lengths; unknown ones are skipped."""
        gone = refs.select(F.col(f"`{refs.columns[0]}`").alias("ref")).distinct()
        cut = lambda df: None if df is None else df.join(gone, "ref", "left_anti")
        return replace(self, documents=cut(self.documents), lengths=cut(self.lengths))

    @property
    def length(self) -> int:
        return 0 if self.documents is None else self.documents.count()

    def add_field_lengths(self, lengths: DataFrame) -> DocumentStore:
        """Sets lengths from rows (ref, field, len); rows of unknown refs are skipped."""
        new = lengths.select("ref", "field", F.col("len").cast("long").alias("len")).join(self._documents().select("ref"), "ref", "left_semi").dropDuplicates(["ref", "field"])
        kept = None if self.lengths is None else self.lengths.join(new.select("ref", "field"), ["ref", "field"], "left_anti")
        return replace(self, lengths=new if kept is None else kept.unionByName(new))

    def add_field_length(self, spark: SparkSession, ref, field: str, length: int) -> DocumentStore:
        if self.documents is None:
            return self
        kind = self.documents.schema["ref"].dataType.simpleString()
        return self.add_field_lengths(spark.createDataFrame([(ref, field, length)], f"ref {kind}, field string, len long"))

    update_field_length = add_field_length

    def field_length(self, ref, field: str) -> int | None:
        """The length, or None if it is unknown."""
        if self.lengths is None:
            return None
        row = self.lengths.where((F.col("ref") == F.lit(ref)) & (F.col("field") == field)).first()
        return None if row is None else row.len

    def reset(self) -> DocumentStore:
        return DocumentStore(save=self.save)

    def _documents(self) -> DataFrame:
        if self.documents is None:
            raise ValueError("the store has no documents")
        return self.documents
