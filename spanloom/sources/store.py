"""Stores of chunks, vectors and term lists: Parquet by strategy and bucket, versioned, with a format guard.

A document's rows lie in one bucket, so a change rewrites the buckets of the documents it touches and no others.  Each
change writes new files first and then publishes the next pointer, a small file that appears at once by a rename; readers
and retried jobs see whole states, and a writer that lost a race fails.  Files that neither the new nor the last pointer
names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.kernels import hashed_vectors, term_lists
from spanloom.operators import dense
from spanloom.operators.lexical import LexicalIndex, statistics

FORMAT_VERSION = 2
BUCKETS = 64


def upserted(held: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The held rows with those of ``new`` put in their place; of rows with one key in ``new`` any one is taken once."""
    fresh = new.dropDuplicates([key]).select(*held.columns)
    return held.join(fresh.select(key), key, "left_anti").select(*held.columns).unionByName(fresh)


def without_document(held: DataFrame, relative_path: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(rows left, one-row count of what goes)."""
    gone = (F.col("relative_path") == relative_path) & (F.col("strategy") == strategy)
    return held.where(~F.coalesce(gone, F.lit(False))), held.where(gone).agg(F.count("*").alias("deleted"))


def get_many(held: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The wanted chunks in order of ``position``, repeated as asked; an id that isn't held is an error. wanted: position, chunk_id."""
    from spanloom.operators.fusion import hydrate

    return hydrate(wanted, held, key).orderBy("position")


def consistency(**ids: DataFrame) -> DataFrame:
    """(left, right, chunk_id): every id that one side has and another lacks, for each pair of tables in both directions."""
    out = None
    for a, left in sorted(ids.items()):
        for b, right in sorted(ids.items()):
            if a != b:
                lacking = left.select("chunk_id").join(right.select("chunk_id"), "chunk_id", "left_anti").select(F.lit(a).alias("held_by"), F.lit(b).alias("missing_in"), "chunk_id")
                out = lacking if out is None else out.unionByName(lacking)
    return out


class ChunkStore:
    """Rows with ``chunk_id`` and ``relative_path`` under one folder; other columns are the writer's."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}".rstrip("/"))

    # -- the pointer ----------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        folder = self._path("pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _held(self) -> dict[str, dict[str, str]]:
        """strategy -> bucket -> folder, of the newest pointer."""
        numbers = self._numbers()
        if not numbers:
            return {}
        state = json.loads(self.spark.read.text(f"{self.root}/pointers/{numbers[-1]:09d}.json", wholetext=True).first()["value"])
        if state["format"] != FORMAT_VERSION or state["buckets"] != self.buckets:
            raise ValueError("the store has another format version or number of buckets; rebuild it")
        return state["held"]

    def _publish(self, held: dict[str, dict[str, str]]) -> None:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        aside, target = self._path(f"pointers/.{uuid.uuid4().hex}"), self._path(f"pointers/{number:09d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"format": FORMAT_VERSION, "buckets": self.buckets, "held": held}).encode()))
        out.close()
        if not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError("another writer has changed the store; read it again and retry")
        for old in numbers[:-1]:
            self._forget(old, held)

    def _forget(self, number: int, held: dict[str, dict[str, str]]) -> None:
        """Remove a pointer from before the last one, and the folders that only it names."""
        path = f"pointers/{number:09d}.json"
        old = json.loads(self.spark.read.text(f"{self.root}/{path}", wholetext=True).first()["value"])["held"]
        last = json.loads(self.spark.read.text(f"{self.root}/pointers/{self._numbers()[-2]:09d}.json", wholetext=True).first()["value"])["held"]
        used = {f for state in (held, last) for own in state.values() for f in own.values()}
        for folder in {f for own in old.values() for f in own.values()} - used:
            self._fs.delete(self._path(folder), True)
        self._fs.delete(self._path(path), False)

    # -- reading --------------------------------------------------------------------------------------------------

    def strategies(self) -> list[str]:
        return sorted(self._held())

    def read(self, strategy: str, relative_path: str | None = None) -> DataFrame | None:
        """The rows of a strategy, of one document if it is named, or None if the strategy has none; no other files are opened."""
        held = self._held().get(strategy)
        if relative_path is not None and held is not None:
            own = str(self._bucket_of(relative_path))
            held = {own: held[own]} if own in held else None
        if not held:
            return None
        rows = self.spark.read.parquet(*(f"{self.root}/{f}" for _, f in sorted(held.items()))).withColumn("strategy", F.lit(strategy))
        return rows if relative_path is None else rows.where(F.col("relative_path") == relative_path)

    def get(self, strategy: str, chunk_id) -> Row | None:
        rows = self.read(strategy)
        return None if rows is None else rows.where(F.col("chunk_id") == chunk_id).first()

    def contains(self, strategy: str, chunk_id) -> bool:
        return self.get(strategy, chunk_id) is not None

    def size(self, strategy: str) -> int:
        rows = self.read(strategy)
        return 0 if rows is None else rows.count()

    def ids(self, strategy: str, **equal) -> DataFrame | None:
        """(chunk_id) in order of the rows whose columns have the given values; only those columns are read."""
        rows = self.read(strategy)
        for name, value in equal.items():
            rows = None if rows is None else rows.where(F.col(name) == value)
        return None if rows is None else rows.select("chunk_id").orderBy("chunk_id")

    def iterate(self, strategy: str) -> Iterator[Row]:
        """The rows in order of chunk_id, a partition at a time in the driver."""
        rows = self.read(strategy)
        return iter(()) if rows is None else rows.orderBy("chunk_id").toLocalIterator(prefetchPartitions=True)

    # -- writing --------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("relative_path", F.lit(""))), F.lit(self.buckets)).cast("int")

    def _bucket_of(self, relative_path: str) -> int:
        return self.spark.range(1).select(F.lit(relative_path).alias("relative_path")).select(self._bucket().alias("b")).first()["b"]

    def _replace_buckets(self, strategy: str, rows: DataFrame, touched: list[int] | None) -> None:
        version = f"strategy={strategy}/{uuid.uuid4().hex}"
        path = f"{self.root}/{version}"
        rows.drop("strategy", "bucket").withColumn("bucket", self._bucket()).write.option("compression", "zstd").partitionBy("bucket").parquet(path)  # each task writes its rows of each bucket: no text is shuffled
        made = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._path(version)) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
        held = self._held()
        own = {} if touched is None else {b: f for b, f in held.get(strategy, {}).items() if int(b) not in set(touched)}
        own |= {b: f"{version}/bucket={b}" for b in made}
        self._publish({s: v for s, v in (held | {strategy: own}).items() if v})

    def replace(self, strategy: str, rows: DataFrame) -> None:
        """All rows of a strategy anew."""
        self._replace_buckets(strategy, rows, None)

    def _of_buckets(self, strategy: str, touched: list[int]) -> DataFrame | None:
        held = {b: f for b, f in self._held().get(strategy, {}).items() if int(b) in set(touched)}
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in held.values())) if held else None

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, strategy: str, rows: DataFrame) -> None:
        """Rows put in place of those with their ids; an id is expected to stay with its document."""
        touched = self._touched(rows)
        held = self._of_buckets(strategy, touched)
        new = rows.drop("strategy")
        if touched:
            self._replace_buckets(strategy, new.dropDuplicates(["chunk_id"]) if held is None else upserted(held, new), touched)

    def replace_documents(self, strategy: str, paths: DataFrame, rows: DataFrame) -> None:
        """``rows`` in place of all that is held of the documents ``paths`` (relative_path)."""
        touched = self._touched(paths)
        held = self._of_buckets(strategy, touched)
        new = rows.drop("strategy")
        if held is not None:
            new = held.join(paths.select("relative_path").distinct(), "relative_path", "left_anti").select(*new.columns).unionByName(new)
        if touched:
            self._replace_buckets(strategy, new, touched)

    def delete_document(self, strategy: str, relative_path: str) -> int:
        """How many rows have gone; the document's bucket alone is rewritten."""
        own = self.read(strategy, relative_path)
        n = 0 if own is None else own.count()
        if n:
            bucket = self._bucket_of(relative_path)
            held = self._of_buckets(strategy, [bucket])
            self._replace_buckets(strategy, held.where(~F.col("relative_path").eqNullSafe(relative_path)), [bucket])
        return n

    def delete_strategy(self, strategy: str) -> int:
        n, held = self.size(strategy), self._held()
        if held.pop(strategy, None) is not None:
            self._publish(held)
        return n


class LexicalStore(ChunkStore):
    """Term lists by strategy; statistics are those of the strategy's rows when it is loaded."""

    def index(self, strategy: str, chunks: DataFrame) -> None:
        self.replace(strategy, self.lists(chunks))

    def index_documents(self, strategy: str, paths: DataFrame, chunks: DataFrame) -> None:
        """Only the buckets of these documents are written; every idf follows at the next load."""
        self.replace_documents(strategy, paths, self.lists(chunks))

    @staticmethod
    def lists(chunks: DataFrame) -> DataFrame:
        key = F.struct("chunk_id", "relative_path")
        return term_lists(chunks.select(key.alias("key"), "text"), "key", "key").select("key.chunk_id", "key.relative_path", "dl", "terms", "tfs")

    def load(self, strategy: str) -> LexicalIndex:
        lists = self.read(strategy)
        if lists is None:
            raise ValueError(f"no index of {strategy}")
        return LexicalIndex(lists, *statistics(lists))


class VectorStore(ChunkStore):
    """Vectors by strategy with whatever columns describe them."""

    def embed(self, strategy: str, lists: DataFrame, dimension: int = 64) -> None:
        """Hashed vectors of term lists (chunk_id, relative_path, terms, tfs)."""
        self.replace(strategy, hashed_vectors(lists, "chunk_id", dimension).join(lists.select("chunk_id", "relative_path"), "chunk_id"))

    def search(self, strategy: str, questions: DataFrame, k: int, **equal) -> DataFrame:
        """The k nearest of the rows whose columns have the given values."""
        rows = self.read(strategy)
        if rows is None:
            raise ValueError(f"no vectors of {strategy}")
        for name, value in equal.items():
            rows = rows.where(F.col(name) == value)
        return dense.top_k(rows.select("chunk_id", "vector"), questions, k)


class DocumentStore:
    """Processed documents with a manifest of their sources' digests: relative_path, doc_id, content_hash, digest and sections."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, documents: DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """documents of :func:`files.assemble`; sources: relative_path, digest.  The manifest, written last, is returned."""
        documents.write.mode("overwrite").parquet(f"{self.root}/documents")
        held = self.spark.read.parquet(f"{self.root}/documents")
        rows = held.select("relative_path", "doc_id", "content_hash", F.size("sections").alias("sections"), F.lit(FORMAT_VERSION).alias("format"))
        digests = rows.select("relative_path", F.col("content_hash").alias("digest")) if sources is None else sources.select("relative_path", "digest")
        rows.join(digests, "relative_path", "left").write.mode("overwrite").parquet(f"{self.root}/manifest")
        return self.manifest()

    def manifest(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/manifest")
        if not rows.where(F.col("format") != FORMAT_VERSION).isEmpty():
            raise ValueError("the documents have another format version; process them again")
        return rows

    def load(self) -> DataFrame:
        """The documents that the manifest names."""
        return self.spark.read.parquet(f"{self.root}/documents").join(self.manifest().select("relative_path"), "relative_path", "left_semi")
