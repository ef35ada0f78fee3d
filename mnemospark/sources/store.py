"""A store of memories as parquet tables: upsert, delete, lookups, searches.

Tables are cut into buckets by a hash of their key. A change writes new files for the buckets it touches and
then one manifest, which names the files of every bucket of every table: all tables change in one step. Manifests are
numbered and never replaced; a reader takes the last one, and the last few, with their files, are kept for readers
that began before. Two writers can't both create a number, so the later one fails instead of losing the other's rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemospark import schemas
from mnemospark.config import Config
from mnemospark.operators.similarity import best_per_group, knn, within_threshold
from mnemospark.session import cut

#: Buckets of a table: what a small change rewrites is a part of the table in this number.
BUCKETS = 256
#: Manifests that are kept.
KEPT = 5


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order`` (null first); equal ones are told apart by their content. Rows without keys are left out."""
    rest = [c for c in df.columns if c not in keys]
    ties = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest])
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), ties)
    ranked = df.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("__n", F.row_number().over(w))
    return ranked.where("__n = 1").drop("__n")


class Store:
    """Tables under one folder; ``tables`` gives each one's schema and the column it is cut by."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[StructType, str]], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    # manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit())

    def _manifest(self, number: int | None = None) -> tuple[int, dict[str, dict[str, str]]]:
        """The number and, per table, the folder of each bucket."""
        number = number if number is not None else max(self._numbers(), default=0)
        if not number:
            return 0, {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/manifests/{number:012d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def _commit(self, before: int, state: dict[str, dict[str, str]]) -> None:
        fs, path = self._fs()
        stream = fs.create(path(f"{self.path}/manifests/{before + 1:012d}"), False)  # fails if another writer was there first
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        numbers = self._numbers()
        if len(numbers) > KEPT:
            kept = [self._manifest(n)[1] for n in numbers[-KEPT:]]
            used = {folder for m in kept for t in m.values() for folder in t.values()}
            for n in numbers[:-KEPT]:
                for folder in {f for t in self._manifest(n)[1].values() for f in t.values()} - used:
                    fs.delete(path(f"{self.path}/{folder}"), True)
                fs.delete(path(f"{self.path}/manifests/{n:012d}"), False)

    # tables

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def load(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        """All rows of a table, or of some of its buckets; an empty table before the first write."""
        return self._read(name, self._manifest()[1], buckets)

    def _read(self, name: str, state: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = self.tables[name][0]
        at = state.get(name, {})
        folders = sorted(f"{self.path}/{f}" for b, f in at.items() if buckets is None or b in buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        return bool(self._manifest()[1].get(name))

    def change(self, gone: DataFrame | None, new: dict[str, DataFrame], without: tuple[str, ...] = ()) -> None:
        """Drop the rows with the keys of ``gone`` from every table but those in ``without``, add ``new`` rows, all in one step.

        ``gone`` has one column, the key. Only buckets with such keys or rows are rewritten.
        """
        before, state = self._manifest()
        after = dict(state)
        for name, (schema, key) in self.tables.items():
            add = new.get(name)
            if name in without or (add is None and (gone is None or not state.get(name))):
                continue
            bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
            touched = []
            if gone is not None:
                touched.append(gone.select(F.col(gone.columns[0]).alias(key)).select(bucket.alias("b")))
            if add is not None:
                add = cut(add.select(*[(F.col(f.name) if f.name in add.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
                touched.append(add.select(bucket.alias("b")))
            one = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
            buckets = [str(r["b"]) for r in one.distinct().collect()]  # at most as many as there are buckets
            rows = self._read(name, state, buckets)
            if gone is not None:
                rows = rows.join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_anti")
            if add is not None:
                rows = rows.unionByName(add)
            after[name] = {b: f for b, f in state.get(name, {}).items() if b not in buckets} | self._write(name, rows)
        self._commit(before, after)

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """The folders of the buckets written; those without rows aren't there."""
        folder = f"{name}/{uuid.uuid4().hex}"
        fields = [f.name for f in self.tables[name][0]]
        rows.withColumn("__b", self._bucket(name)).repartition("__b").select(*fields, "__b").write.partitionBy("__b").parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(path(f"{self.path}/{folder}"))]
        return {n.removeprefix("__b="): f"{folder}/{n}" for n in names if n.startswith("__b=")}


class MemoryStore(Store):
    """Memories and their child tables under one folder."""

    TABLES = ("memories", "fake_queries", "content_chunks", "paragraphs", "knowledge_points")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, {n: (getattr(schemas, n.upper()), "memory_id") for n in self.TABLES}, buckets)

    def load(self, name: str = "memories", buckets: list[str] | None = None) -> DataFrame:
        return super().load(name, buckets)

    def save(self, **frames: DataFrame) -> None:
        """Upsert: rows of the given memories replace all that is stored of them; a memory given twice counts once, the later row.

        What isn't given of a memory is gone afterwards, since its text may be another: children without their memory would be wrong.
        """
        frames = frames | {"memories": latest(frames["memories"], ["memory_id"], "created_at")}
        self.change(cut(frames["memories"].select("memory_id").distinct()), frames)

    def get(self, memory_id: str) -> DataFrame:
        """The memory, read from its bucket."""
        b = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(memory_id)), F.lit(self.buckets)).cast("string").alias("b")).first()["b"]
        return self.load("memories", [b]).where(F.col("memory_id") == memory_id)

    def get_many(self, ids: DataFrame) -> DataFrame:
        return self.load().join(ids, "memory_id", "left_semi")

    def delete(self, memory_id: str) -> bool:
        """Delete a memory with all that belongs to it; whether it was there."""
        there = not self.get(memory_id).isEmpty()
        if there:
            self.change(self.spark.createDataFrame([(memory_id,)], "memory_id string"), {})
        return there

    def missing(self, wanted: DataFrame, name: str) -> DataFrame:
        """The wanted memories of which table ``name`` holds nothing yet."""
        return wanted.join(self.load(name).select("memory_id"), "memory_id", "left_anti")

    def count(self) -> int:
        return self.load().count()

    def clear(self) -> None:
        self._commit(self._manifest()[0], {})

    # searches, for many queries at once: ``queries`` has ``sub_id`` and ``embedding``

    def search_fake_queries(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """``sub_id, query_id, memory_id, text, parent_ids, depth, score, rank`` of the nearest fake queries; scores are at least 0."""
        f = self.load("fake_queries")
        near = knn(queries, "sub_id", f, "query_id", top_k).join(f.drop("embedding"), "query_id")
        return near.select("sub_id", "query_id", "memory_id", "text", "parent_ids", "depth", F.greatest("sim", F.lit(0.0)).alias("score"), "rank")

    def search_all_fake_queries(self, queries: DataFrame, threshold: float = Config.version_threshold, max_results: int = Config.max_hits) -> DataFrame:
        """As ``search_fake_queries``, of those with a score of at least ``threshold``."""
        f = self.load("fake_queries")
        near = within_threshold(queries, "sub_id", f, "query_id", threshold, max_results).join(f.drop("embedding"), "query_id")
        return near.select("sub_id", "query_id", "memory_id", "text", "parent_ids", "depth", F.col("sim").alias("score"), "rank")

    def fake_queries(self, ids: DataFrame) -> DataFrame:
        """Fake queries by id (``query_id``); unknown ids are left out."""
        return self.load("fake_queries").join(ids.select("query_id").distinct(), "query_id", "left_semi")

    def search_content(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """``sub_id, memory_id, chunk_index, score, rank`` of the nearest chunks."""
        c = self.load("content_chunks").withColumn("key", F.concat_ws("#", "memory_id", "chunk_index"))
        near = knn(queries, "sub_id", c, "key", top_k).join(c.drop("embedding"), "key")
        return near.select("sub_id", "memory_id", "chunk_index", F.greatest("sim", F.lit(0.0)).alias("score"), "rank")

    def search_content_for_memories(self, queries: DataFrame) -> DataFrame:
        """``sub_id, memory_id, score``: the best chunk of every memory."""
        c = self.load("content_chunks").withColumn("key", F.concat_ws("#", "memory_id", "chunk_index"))
        return best_per_group(queries, "sub_id", c, "key", "memory_id", "chunk_index").select("sub_id", "memory_id", F.greatest("sim", F.lit(0.0)).alias("score"))

    def search_paragraphs_for_memories(self, queries: DataFrame, top_k: int = Config.paragraph_top_k) -> DataFrame:
        """``sub_id, memory_id, paragraph_index, text, score, rank``: the nearest paragraphs of every memory."""
        p = self.load("paragraphs").withColumn("key", F.concat_ws("#", "memory_id", "paragraph_index"))
        best = best_per_group(queries, "sub_id", p, "key", "memory_id", "paragraph_index", top_k)
        return best.join(p.select("key", "text"), "key").select("sub_id", "memory_id", "paragraph_index", "text", F.greatest("sim", F.lit(0.0)).alias("score"), "rank")

    def search_kps_for_memories(self, queries: DataFrame, top_k: int = Config.linked_kp_top_k) -> DataFrame:
        """``sub_id, memory_id, kp_index, line, score, rank``: the nearest facts of every memory."""
        from mnemospark.operators.versioning import kp_line

        k = self.load("knowledge_points").withColumn("key", F.concat_ws("#", "memory_id", "kp_index"))
        best = best_per_group(queries, "sub_id", k, "key", "memory_id", "kp_index", top_k)
        return best.join(k.select("key", kp_line().alias("line")), "key").select("sub_id", "memory_id", "kp_index", "line", F.greatest("sim", F.lit(0.0)).alias("score"), "rank")

    # documents

    def documents(self) -> DataFrame:
        """Each memory as one nested document with all that belongs to it."""
        _, state = self._manifest()
        out = self._read("memories", state)
        field = lambda c: lambda e: e[c]
        lists = {
            "content_chunks": ("chunk_index", {"content_embeddings": "embedding"}), "paragraphs": ("paragraph_index", {"paragraphs": "text", "paragraph_embeddings": "embedding"}),
        }
        for name, (order, fields) in lists.items():
            l = self._read(name, state).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields.values()))).alias("l"))  # a memory's children
            out = out.join(l.select("memory_id", *[F.transform("l", field(c)).alias(n) for n, c in fields.items()]), "memory_id", "left")
        fake = F.struct("query_id", "memory_id", "text", "answer", "embedding", "parent_ids", "depth")
        l = self._read("fake_queries", state).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("pos", "query_id", fake.alias("f")))).alias("l"))
        out = out.join(l.select("memory_id", F.transform("l", lambda e: e["f"]).alias("fake_queries")), "memory_id", "left")
        point = F.struct("time", "subject", "fact", "entities_or_values")
        l = self._read("knowledge_points", state).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("kp_index", point.alias("k")))).alias("l"))
        out = out.join(l.select("memory_id", F.transform("l", lambda e: e["k"]).alias("knowledge_points")), "memory_id", "left")
        empty = lambda f: F.coalesce(F.col(f.name).cast(f.dataType), F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else F.col(f.name).cast(f.dataType)
        return out.select(*[empty(f).alias(f.name) for f in schemas.MEMORY_DOCUMENT])

    def save_documents(self, documents: DataFrame) -> None:
        """Upsert nested documents, as ``read_json`` gives them. Missing lists count as empty."""
        d = cut(latest(documents, ["memory_id"], "created_at"))
        each = lambda c, i: d.select("memory_id", F.posexplode(c).alias(i, "x"))
        paired = d.select("memory_id", "paragraph_embeddings", F.posexplode("paragraphs").alias("paragraph_index", "text"))
        self.save(
            memories=d.select("memory_id", F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("session_id"), "session_text", "metadata", "created_at"),
            content_chunks=each("content_embeddings", "chunk_index").withColumnRenamed("x", "embedding"),
            paragraphs=paired.select("memory_id", "paragraph_index", "text", F.get("paragraph_embeddings", F.col("paragraph_index")).alias("embedding")),
            fake_queries=each("fake_queries", "pos").select("memory_id", "pos", "x.query_id", "x.text", "x.answer", "x.embedding", "x.parent_ids", F.coalesce("x.depth", F.lit(0)).alias("depth")),
            knowledge_points=each("knowledge_points", "kp_index").select("memory_id", "kp_index", "x.time", "x.subject", "x.fact", "x.entities_or_values"),
        )

    def read_json(self, path: str) -> DataFrame:
        """A file with a list of nested memories; missing lists and texts come out empty."""
        raw = self.spark.read.schema(schemas.MEMORY_DOCUMENT).option("multiLine", True).json(path)
        empty = {"array": lambda f: F.array().cast(f.dataType), "map": lambda f: F.create_map().cast(f.dataType), "string": lambda f: F.lit("")}
        fill = lambda f: F.coalesce(f.name, empty[f.dataType.typeName()](f)) if f.name != "memory_id" else F.col(f.name)
        return raw.select(*[fill(f).alias(f.name) for f in raw.schema])

    def write_json(self, path: str) -> None:
        """All documents as JSON lines."""
        self.documents().write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class VectorStore(Store):
    """Vectors of an experiment: of sessions by method, of true queries, of paraphrases; filled step by step."""

    KEYS = {"vectors": ["method", "session_id"], "paraphrases": ["query_id"], "true_queries": ["query_id"]}

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, {n: (getattr(schemas, n.upper()), k[-1]) for n, k in self.KEYS.items()}, buckets)

    def missing(self, name: str, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose keys aren't stored."""
        keys = self.KEYS[name]
        return wanted.join(self.load(name).select(*keys).distinct(), keys, "left_anti")

    def add(self, name: str, texts: DataFrame, embedder) -> None:
        """Embed the texts whose keys aren't stored yet, and store them; without any nothing is written."""
        from mnemospark.providers import embed

        new = cut(self.missing(name, texts))
        if not new.isEmpty():
            self.change(None, {name: new.withColumn("embedding", embed("text", embedder))})

    def listed(self, name: str) -> DataFrame:
        return self.load(name).select(*self.KEYS[name]).distinct()
