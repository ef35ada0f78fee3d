"""The most similar vectors for every vector, by score-aware quantisation.

A bounded sample gives coarse centroids, which cut the collection into lists, and the
codebooks of a product quantiser: pairs of dimensions, sixteen codewords each, so four bits a
pair. The codebooks minimise an anisotropic loss, in which the part of the residual parallel
to the vector weighs more than the rest, as it is what falsifies high inner products.

Every vector is held, as codes and exactly, in the list of its nearest centroid, and looks for
neighbours there and in the lists of its next nearest ones. In a list, the four-bit tables of
a block of queries are scanned as one product of the queries with the decoded codes, which
has the same sums; what the scan keeps is reranked by exact cosine. Found pairs count for
both their vectors, since every vector is both a query and held.

Of many equal vectors only a few are held, which are the neighbours of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import cut, partitions_for

#: Vectors in the sample on which the index is fitted, at most about this many.
SAMPLE = 20_000
#: Of these, vectors on which the codebooks are fitted; pairs of dimensions have only 16 codewords each.
FITTED = 5_000
#: Weight of the parallel part of the residual is (d - 1) * T^2 / (1 - T^2) times that of the rest.
THRESHOLD = 0.2
CODEWORDS = 16
#: Vectors that a block of a list holds at most on average, and queries scanned at a time.
BLOCK = 4_096
SCAN = 1_024
#: Vectors that look into a block at most on average.
LOOKS = 32_768
#: Lists that are searched before the others, for a bound.
FIRST = 4
#: A scanned score is off by a vector's error times the cosine of its angle with the query, which is about 1 / sqrt(dims); so many times that is allowed for.
USUAL_ERROR = 2.5


@dataclass
class Index:
    """Coarse centroids (lists x dimensions) and codebooks (pairs of dimensions x 16 x 2)."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists nearest to each row, nearest first; ties go to the lower list."""
        s = x @ self.centroids.T
        n = min(n, s.shape[1])
        if n == 1:
            return s.argmax(1)[:, None]
        part = np.argpartition(-s, n - 1, axis=1)[:, :n]
        part.sort(axis=1)
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x pairs) with the least anisotropic loss that coordinate descent finds."""
        return _assign(x, self.codebooks, sweeps)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        pairs = self.codebooks.shape[0]
        return self.codebooks[np.arange(pairs)[None, :], codes].reshape(len(codes), 2 * pairs)


def _extra(dims: int) -> float:
    """What the parallel part weighs more than the rest; never less."""
    return max(0.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)


def _assign(x: np.ndarray, books: np.ndarray, sweeps: int) -> np.ndarray:
    n, pairs = len(x), books.shape[0]
    sub = x.reshape(n, pairs, 2)
    more = np.float32(_extra(2 * pairs))
    codes = np.empty((n, pairs), np.uint8)
    along = np.empty((n, pairs), np.float32)  # of the residual, times the vector, by pair
    for s in range(pairs):
        codes[:, s] = (-2 * sub[:, s] @ books[s].T + (books[s] ** 2).sum(1)).argmin(1)
        along[:, s] = ((sub[:, s] - books[s][codes[:, s]]) * sub[:, s]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(pairs):
            dots = sub[:, s] @ books[s].T
            own = (sub[:, s] ** 2).sum(1)[:, None] - dots
            loss = (books[s] ** 2).sum(1)[None, :] - 2 * dots + more * ((total - along[:, s])[:, None] + own) ** 2
            best = loss.argmin(1)
            codes[:, s] = best
            now = np.take_along_axis(own, best[:, None], 1)[:, 0]
            total += now - along[:, s]
            along[:, s] = now
    return codes


def _train_books(x: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    n, dims = x.shape
    pairs, more = dims // 2, _extra(dims)
    sub = x.reshape(n, pairs, 2)
    pick = rng.choice(n, CODEWORDS, replace=n < CODEWORDS)
    books = np.ascontiguousarray(sub[pick].transpose(1, 0, 2)).astype(np.float32)
    for _ in range(rounds):
        codes = _assign(x, books, 1)
        chosen = books[np.arange(pairs)[None, :], codes]
        along = ((sub - chosen) * sub).sum(2)
        rest = along.sum(1)[:, None] - along
        for s in range(pairs):
            v = sub[:, s].astype(np.float64)
            lhs = np.eye(2)[None] + more * v[:, :, None] * v[:, None, :]
            rhs = v + more * v * (rest[:, s] + (v**2).sum(1))[:, None]
            for c in range(CODEWORDS):
                at = codes[:, s] == c
                if at.any():
                    books[s, c] = np.linalg.solve(lhs[at].sum(0), rhs[at].sum(0))
    return books


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> Index:
    """An index from unit vectors (rows x an even number of dimensions)."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float32)
    for _ in range(8):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        filled = np.bincount(near, minlength=lists) > 0
        centroids[filled] = sums[filled]
        centroids /= np.linalg.norm(centroids, axis=1, keepdims=True) + 1e-12
    return Index(centroids, _train_books(sample[: min(len(sample), FITTED)], rng))


# ---------------------------------------------------------------- search


def _valid(x: np.ndarray) -> np.ndarray:
    """Rows that can have neighbours: all elements finite, not all zero."""
    return np.isfinite(x).all(1) & (x != 0).any(1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column whose rows all have ``dims`` elements; null elements as NaN."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


def _matrix(packed: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(-1, dims)


_PAIR = "key string, other string, similarity double"


def _scan(pdf: pd.DataFrame, index: Index, k: int, least: float | None, dims: int) -> pd.DataFrame:
    """Neighbours, in both directions, between the vectors that look into a block (those with a ``bound``) and those it holds (those with a ``code``).

    Only similarities of a key's ``bound``, or ``floor`` if it is held, or more count. At most ``k`` a key come out.
    """
    held, asks = pdf["code"].notna().to_numpy(), pdf["bound"].notna().to_numpy()
    none = pd.DataFrame({"key": pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "similarity": np.zeros(0)})
    if not held.any() or not asks.any():
        return none
    names = pdf["key"].to_numpy(dtype=object)
    x = _matrix(pdf["vec"], dims)
    items, item_names, floors = x[held], names[held], pdf["floor"].to_numpy(np.float32)[held]
    queries, query_names, bounds = x[asks], names[asks], pdf["bound"].to_numpy(np.float32)[asks]
    packed = np.frombuffer(b"".join(pdf["code"][held]), np.uint8).reshape(held.sum(), -1)
    codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
    decoded = index.decode(codes)
    off = np.linalg.norm(items - decoded, axis=1)  # how far a scanned score can be off
    slack = off if least is not None else np.float32(USUAL_ERROR) * off / np.sqrt(np.float32(dims))
    depth = 2 * k
    found_q, found_i, found_s = [], [], []
    for at in range(0, len(queries), SCAN):
        q = queries[at : at + SCAN]
        scores = q @ decoded.T
        scores += slack
        keep = np.zeros(scores.shape, bool)
        for s, m, lows in ((scores, keep, bounds[at : at + SCAN]), (scores.T, keep.T, floors)):
            hit = s >= lows[:, None] - 1e-4
            if least is None and s.shape[1] > depth:
                rows = np.flatnonzero(hit.sum(1) > depth)
                part = s[rows]
                hit[rows] &= part >= np.partition(part, part.shape[1] - depth, axis=1)[:, part.shape[1] - depth][:, None]
            m |= hit
        qi, ii = np.nonzero(keep)
        for lo in range(0, len(qi), 500_000):
            a, b = qi[lo : lo + 500_000], ii[lo : lo + 500_000]
            kind = np.float32 if least is None else np.float64
            exact = np.einsum("ij,ij->i", q[a].astype(kind, copy=False), items[b].astype(kind, copy=False)).astype(np.float64)
            other = query_names[at + a] != item_names[b]
            one, two = other & (exact >= bounds[at + a] - 1e-6), other & (exact >= floors[b] - 1e-6)
            found_q += [query_names[at + a[one]], item_names[b[two]]]
            found_i += [item_names[b[one]], query_names[at + a[two]]]
            found_s += [exact[one], exact[two]]
    q, i, sims = (np.concatenate(x) if x else np.zeros(0, object) for x in (found_q, found_i, found_s))
    if not len(q):
        return none
    out = pd.DataFrame({"key": pd.Series(q, dtype=object), "other": pd.Series(i, dtype=object), "similarity": sims.astype(float)})
    if len(out) > k:
        out = out.sort_values(["similarity", "other"], ascending=[False, True]).drop_duplicates(["key", "other"])
        out = out[out.groupby("key", sort=False).cumcount() < k]
    return out


def similar_vectors(df: DataFrame, key: str, vector: str, k: int = 10, dims: int = 64, least: float | None = None, lists: int | None = None, probes: int = 3) -> DataFrame:
    """``key, neighbour, similarity``: up to ``k`` most similar vectors of other keys for every key.

    ``least`` keeps only neighbours with at least this cosine; within the lists searched none
    of these is missed, as the scan allows for the error of each code. Without it, the scan keeps
    the candidates that its usual error allows to beat the bound found in the first lists, at most about twice ``k`` a list. ``lists`` (by default the square root of the number
    of rows) and ``probes`` (lists searched for each vector) set the loss.

    Vectors that are null, all zero, of another number of elements or with elements that aren't
    finite have no neighbours and are nobody's. Repeated rows count once; a key with
    several vectors is searched with each. Ties in similarity go to the smaller key. Rows without
    a key are left out; an empty table gives no rows. ``dims`` must be even.
    """
    spark = df.sparkSession
    if dims % 2:
        raise ValueError("dims must be even")
    rows = _searchable(df, key, vector, dims)
    count = rows.count()
    drawn = F.xxhash64("k", "v")
    sample = rows.where(F.pmod(drawn, F.lit(max(1, count // SAMPLE))) == 0).orderBy(drawn, "k").limit(SAMPLE).toPandas()
    if not len(sample):
        sample = rows.orderBy(drawn, "k").limit(SAMPLE).toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, dims), np.float32)
    x = x[_valid(x)]
    if not len(x):
        return spark.createDataFrame([], "key string, neighbour string, similarity double").toDF(key, "neighbour", "similarity")
    x = _units(x)
    index = fit(x, lists or max(1, round(count**0.5)))
    held = spark.sparkContext.broadcast(index)  # lists x dims floats

    # of more than k + 1 equal vectors, those with the smallest k + 1 keys are searched for all
    keys = rows.select("k", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    crowded = cut(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1))
    extra = None
    if not crowded.isEmpty():
        members = keys.join(crowded.select("h1", "h2"), ["h1", "h2"])
        order = Window.partitionBy("h1", "h2").orderBy("k")
        few = cut(members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1))
        extra = cut(members.join(few.select("h1", "h2", "k"), ["h1", "h2", "k"], "left_anti"))
        left_out = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}).join(extra.select("k", "h1", "h2"), ["k", "h1", "h2"], "left_anti")
        rows = left_out.select("k", "v")

    def placed(rows: DataFrame, lists: range) -> DataFrame:
        """Rows (``k, v`` and perhaps ``bound``) held in their first list and looking into those of the ranks ``lists``."""
        bounded = "bound" in rows.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _vectors(batch.column("v"), dims)
                fine = _valid(x)
                mask = pa.array(fine)
                names, x = batch.column("k").filter(mask), x[fine]
                if not len(x):
                    continue
                x = _units(x)
                near = ix.nearest(x, max(lists.stop, 1))
                vecs, nothing = pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(x), pa.binary())
                bound = batch.column("bound").filter(mask) if bounded else pa.array(np.full(len(x), -2.0 if least is None else least))
                c = ix.encode(x)
                c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
                codes = pa.array([r.tobytes() for r in c[:, 0::2] | (c[:, 1::2] << 4)], pa.binary())
                for i in sorted({*lists, 0}):
                    if i < near.shape[1]:
                        unset = pa.nulls(len(x), pa.float64())
                        mine = i == 0
                        columns = [pa.array(near[:, i].astype(np.int32)), names, vecs, codes if mine else nothing, bound if i in lists else unset, bound if mine else unset]
                        yield pa.RecordBatch.from_arrays(columns, names=["list", "key", "vec", "code", "bound", "floor"])

        return rows.mapInArrow(place, "list int, key string, vec binary, code binary, bound double, floor double")

    def scanned(all_: DataFrame, looks: int) -> DataFrame:
        """Pairs found in the lists; long lists are cut into blocks of vectors held and of vectors that look."""
        cells = _blocks(x, index, count, looks)
        if cells:
            many = spark.createDataFrame([(i, h, q) for i, (h, q) in cells.items()], "list int, hs int, qs int")  # a row per long list
            all_ = all_.join(F.broadcast(many), "list", "left").withColumns({"hs": F.coalesce("hs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
            h, q = F.pmod(F.xxhash64("key"), F.col("hs")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("qs")).cast("int")
            as_held = F.when(F.col("code").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda j: F.struct(h.alias("h"), j.alias("q"))))
            as_query = F.when(F.col("bound").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: F.struct(i.alias("h"), q.alias("q"))))
            none = F.array().cast("array<struct<h:int,q:int>>")
            all_ = all_.withColumns({"own_h": h, "own_q": q}).withColumn("cell", F.explode(F.array_union(F.coalesce(as_held, none), F.coalesce(as_query, none))))
            all_ = all_.select("list", F.col("cell.h").alias("h"), F.col("cell.q").alias("q"), "key", "vec", F.when(F.col("cell.h") == F.col("own_h"), F.col("code")).alias("code"), F.when(F.col("cell.q") == F.col("own_q"), F.col("bound")).alias("bound"), "floor")
        else:
            all_ = all_.withColumns({"h": F.lit(0), "q": F.lit(0)})
        groups = all_.repartition(partitions_for(count * looks, 20_000), "list", "h", "q").groupBy("list", "h", "q")
        return groups.applyInPandas(lambda pdf: _scan(pdf, held.value, k, least, dims), _PAIR)

    best = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")

    def top(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("key", "other").agg(F.max("similarity").alias("similarity"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if least is not None or probes <= FIRST:
        ranked = top(scanned(placed(rows, range(probes)), probes)).select("key", "other", "similarity")
    else:
        # the first lists give each key a bound, below which nothing of the others leaves its task
        near = cut(top(scanned(placed(rows, range(FIRST)), FIRST)))
        bounds = near.groupBy(F.col("key").alias("k")).agg(F.min(F.when(F.col("rank") == k, F.col("similarity"))).alias("bound"))
        asked = rows.select("k", "v").join(bounds, "k", "left").select("k", "v", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        far = scanned(placed(asked, range(FIRST, probes)), probes - FIRST + 1)
        ranked = top(near.select("key", "other", "similarity").unionByName(far)).select("key", "other", "similarity")
    if extra is not None:
        same = extra.withColumnRenamed("k", "key").join(few.where(F.col("n") <= k).withColumnRenamed("k", "other"), ["h1", "h2"])
        ranked = ranked.unionByName(same.select("key", "other", F.lit(1.0).alias("similarity")))
    return ranked.select(F.col("key").alias(key), F.col("other").alias("neighbour"), "similarity")


def _searchable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``k, v`` of the rows with a key and a vector that can have neighbours (NaN counts as the largest element)."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<float>").alias("v"))
    most, least, huge = F.array_max("v"), F.array_min("v"), F.lit(float("inf")).cast("float")
    whole = F.array_contains("v", huge).isNotNull()  # null if an element is null and none is found
    return rows.where(F.col("k").isNotNull() & (F.size("v") == dims) & whole & (most < huge) & (least > -huge) & ((most != 0) | (least != 0)))


def _blocks(sample: np.ndarray, index: Index, count: int, looks: int) -> dict[int, tuple[int, int]]:
    """Into how many blocks of vectors held and of vectors that look each long list is cut, from its share of the sample."""
    near = index.nearest(sample, max(1, looks))
    scale = count / max(1, len(sample))
    held = np.bincount(near[:, 0], minlength=len(index.centroids)) * scale
    asks = np.bincount(near.ravel(), minlength=len(index.centroids)) * scale
    return {i: (max(1, int(-(-h // BLOCK))), max(1, int(-(-q // LOOKS)))) for i, (h, q) in enumerate(zip(held, asks, strict=True)) if h > BLOCK or q > LOOKS}


def measured_queries(df: DataFrame, key: str, vector: str, n: int, dims: int = 64) -> pd.DataFrame:
    """The first ``n`` keys in order of a hash, with their vectors (``k, v``)."""
    some = _searchable(df, key, vector, dims).orderBy(F.xxhash64("k", F.lit(1)), "k").limit(2 * n).toPandas().drop_duplicates("k")
    return some[[_valid(np.asarray(v, np.float32)[None])[0] for v in some["v"]]].head(n)


def exact_neighbours(df: DataFrame, key: str, vector: str, queries: pd.DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """Brute force for a bounded frame of queries (``k, v``), to measure the loss."""
    names = queries["k"].to_numpy()
    q = _units(np.stack(queries["v"].to_numpy())).astype(np.float64) if len(queries) else np.zeros((0, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"), dims) if batch.num_rows else np.zeros((0, dims), np.float32)
            fine = _valid(x)
            if not fine.any() or not len(q):
                continue
            x, other = _units(x[fine]).astype(np.float64), batch.column("k").filter(pa.array(fine)).to_numpy(zero_copy_only=False)
            s = q @ x.T
            s[names[:, None] == other[None, :]] = -2
            n = min(2 * k, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(other[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["key", "neighbour", "similarity"])

    best = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    near = _searchable(df, key, vector, dims).mapInArrow(run, "key string, neighbour string, similarity double").where("similarity > -1.5")
    near = near.groupBy("key", "neighbour").agg(F.max("similarity").alias("similarity"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("key").alias(key), "neighbour", "similarity")
