"""A versioned vector store over Parquet: collections, aliases, upsert, delete, fetch and both search arms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.dense import dense_topk
from quern.operators.ingest import require
from quern.operators.lexical import sparse_search

RECORD = (
    "doc_id string, text string, dense array<float>, sparse map<int,double>, source_key string, document_sha256 string,"
    " ordinal long, metadata map<string,string>"
)


class ParquetStore:
    """Each write makes a new version folder and then moves the collection's pointer, a one-row table, to it.

    Readers resolve the pointer once and keep a whole version; an alias is a second pointer table that names a
    collection, so that a shadow collection is published by one overwrite.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, kind: str, name: str) -> str | None:
        path = f"{self.root}/{kind}/{name}"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            return None
        rows = self.spark.read.schema("target string, sequence long").parquet(path).orderBy(F.desc("sequence")).limit(1).collect()
        return rows[0]["target"] if rows else None

    def _point(self, kind: str, name: str, target: str) -> None:
        path = f"{self.root}/{kind}/{name}"
        before = self._pointer(kind, name)
        last = 0 if before is None else self.spark.read.schema("target string, sequence long").parquet(path).agg(F.max("sequence")).first()[0]
        self.spark.createDataFrame([(target, last + 1)], "target string, sequence long").coalesce(1).write.mode("append").parquet(path)

    def ensure(self, collection: str, width: int) -> None:
        if self._pointer("collections", collection) is None:
            self._write(collection, self.spark.createDataFrame([], RECORD), width)
        elif self.width(collection) != width:
            raise ValueError(f"{collection} holds vectors of another width")

    def _write(self, collection: str, rows: DataFrame, width: int) -> None:
        version = f"{self.root}/versions/{collection}/{width}-{uuid.uuid4().hex}"
        rows.write.parquet(version)
        self._point("collections", collection, version)

    def width(self, collection: str) -> int:
        return int(self._version(collection).rsplit("/", 1)[1].split("-")[0])

    def _version(self, collection: str) -> str:
        version = self._pointer("collections", collection)
        if version is None:
            raise KeyError(collection)
        return version

    def rows(self, name: str) -> DataFrame:
        """The records of a collection or alias; the files' schema must be RECORD's."""
        return self.spark.read.schema(RECORD).parquet(self._version(self.alias_target(name) or name))

    def _writable(self, collection: str) -> None:
        if self.alias_target(collection) is not None:
            raise ValueError("writers name collections, not read aliases")

    def upsert(self, collection: str, records: DataFrame) -> int:
        """Replaces whole rows; repeated ids, wrong widths and non-finite vectors fail before anything changes."""
        self._writable(collection)
        width = self.width(collection)
        fine = (F.size("dense") == width) & F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.length("doc_id") > 0) & (F.length("doc_id") <= 64) & (F.length("source_key") <= 2048) & (F.col("ordinal") >= 0)
        checked = require(records.select(*[F.col(c.split()[0]) for c in RECORD.split(", ")]), fine, "bad record")
        counts = checked.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
        if counts["n"] != counts["d"]:
            raise ValueError("a batch repeats an id")
        kept = self.rows(collection).join(checked.select("doc_id"), "doc_id", "left_anti")
        self._write(collection, kept.unionByName(checked), width)
        return counts["n"]

    def delete(self, collection: str, doc_ids: list[str]) -> int:
        self._writable(collection)
        if len(set(doc_ids)) != len(doc_ids) or not all(doc_ids):
            raise ValueError("ids must be unique and not empty")
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        self._write(collection, self.rows(collection).join(gone, "doc_id", "left_anti"), self.width(collection))
        return len(doc_ids)

    def fetch(self, name: str, doc_ids: list[str]) -> DataFrame:
        """Records in the order of the request, without vectors; unknown ids are left out."""
        wanted = self.spark.createDataFrame(list(enumerate(doc_ids)), "pos int, doc_id string")
        return fetch_ordered(self.rows(name).drop("dense", "sparse"), wanted)

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def search_dense(self, name: str, queries: DataFrame, limit: int) -> DataFrame:
        return dense_topk(self.rows(name).select("doc_id", F.col("dense").alias("v")), queries, limit, include_self=True)

    def search_sparse(self, name: str, terms: DataFrame, limit: int) -> DataFrame:
        """``terms(query_id, term)`` with term indices."""
        vectors = self.rows(name).select("doc_id", F.explode("sparse").alias("term", "weight"))
        return sparse_search(vectors, terms, limit)

    def alias_target(self, alias: str) -> str | None:
        return self._pointer("aliases", alias)

    def activate_alias(self, alias: str, collection: str) -> None:
        self._version(collection)
        self._point("aliases", alias, collection)


def fetch_ordered(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(pos, doc_id)`` in request order."""
    return rows.join(F.broadcast(wanted), "doc_id").orderBy("pos")  # wanted is a request of bounded length


def upsert_rows(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.join(source.select(key), key, "left_anti").unionByName(source)
