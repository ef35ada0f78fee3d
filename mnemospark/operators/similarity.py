"""Exact similarity joins: every query against a pool, as blocked matrix products.

Queries are broadcast only after they have been counted. Beyond ``BROADCAST_QUERIES`` both sides
are cut into blocks, and each pair of blocks is one task: its memory is bounded by two blocks.

A table joined with itself is written once, in packed blocks to the checkpoint folder, from which each
pair of blocks reads: no vector is shuffled more than once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemospark.session import cut, partitions_for

#: Queries that are sent to every task at most, and rows of a block beyond that.
BROADCAST_QUERIES = 20_000
BLOCK = 5_000
#: Scores that a task holds at a time.
SCORES = 4_000_000
#: Rows of a packed block on average, and queries and items of a tile of scores, which stays in the cache.
PACKED = 25_000
TILE = (512, 1_024)
#: Pairs that wait for being ranked, on either side.
WAITING = 1_000_000


def _matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, dims))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _keep(s: np.ndarray, top: int | None, least: float | None, starts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores to keep. With ``starts``, where each group's columns begin, ``top`` counts per group."""
    if starts is not None:
        width = np.diff(np.append(starts, s.shape[1]))
        left, rows, cols = s.copy(), [], []
        for _ in range(min(top, int(width.max()))):
            best = np.maximum.reduceat(left, starts, axis=1)
            hit = left == np.repeat(best, width, axis=1)
            at = np.where(hit, np.arange(s.shape[1])[None, :], s.shape[1])
            first = np.minimum.reduceat(at, starts, axis=1)  # the first column of each group with its best score
            r, g = np.nonzero(best > -2)
            c = first[r, g]
            rows.append(r)
            cols.append(c)
            left[r, c] = -3
        r, c = np.concatenate(rows), np.concatenate(cols)
        fine = s[r, c] >= (-2 if least is None else least)
        return r[fine], c[fine]
    keep = np.ones(s.shape, bool)
    if least is not None:
        keep &= s >= least
    if top is not None and s.shape[1] > top:
        keep &= s >= -np.partition(-s, top - 1, axis=1)[:, top - 1 : top]
    return np.nonzero(keep)


def similarities(queries: DataFrame, query: str, pool: DataFrame, item: str, vector: str = "embedding", dims: int = 64, top: int | None = None, least: float | None = None, group: str | None = None, order: str | None = None) -> DataFrame:
    """``query, item, sim`` for every pair, or per task only the ``top`` of each query or those from ``least`` on.

    Cosine in double precision, rounded to 9 decimals so that equal vectors of different length
    tie; 0 if a vector is all zero. Vectors that are null or of another size have no pairs. Both
    keys must be unique; a pair of equal keys is left out only if the columns have one name.
    ``top`` is a combiner: the caller still ranks what is left. With ``group`` it counts for each query and group, ties go to the
    smaller ``order``, and both columns come out too: what leaves a task then grows with groups, not with the pool.
    """
    fine = F.col(vector).isNotNull() & (F.size(vector) == dims)
    q = queries.where(fine).select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    more = [] if group is None else [F.col(group).alias("g"), F.col(order).alias("o")]
    p = pool.where(fine).select(F.col(item).alias("p"), *more, F.col(vector).cast("array<double>").alias("v"))
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    carried = ["p", *(["g", "o"] if group else [])]
    schema = ", ".join([kind(q, "q"), *[kind(p, c) for c in carried], "sim double"])

    def pairs(qn: np.ndarray, qx: np.ndarray, columns: list[np.ndarray], px: np.ndarray) -> Iterator[list[np.ndarray]]:
        starts = None
        if group and len(px):
            at = pd.DataFrame({"g": columns[1], "o": columns[2], "p": columns[0]}).sort_values(["g", "o", "p"], kind="stable").index.to_numpy()
            columns, px = [c[at] for c in columns], px[at]
            starts = np.flatnonzero(np.append(True, columns[1][1:] != columns[1][:-1]))
        some = max(1, SCORES // max(1, len(px)))  # so many queries at a time
        for at in range(0, len(qx), some):
            s = np.round(qx[at : at + some] @ px.T, 9)
            a, b = _keep(s, top, least, starts)
            yield [qn[at + a], *[c[b] for c in columns], s[a, b]]

    if q.count() <= BROADCAST_QUERIES:
        local = q.toPandas()  # bounded by BROADCAST_QUERIES
        qn, qx = local["q"].to_numpy(), _unit(_matrix(local["v"], dims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(qn):
                    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in carried]
                    for found in pairs(qn, qx, columns, _unit(_matrix(batch.column("v"), dims))):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["q", *carried, "sim"])

        out = p.mapInArrow(run, schema)
    else:
        nq, np_ = -(-q.count() // BLOCK), max(1, -(-p.count() // BLOCK))
        qb = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
        pb = p.withColumn("pb", F.pmod(F.xxhash64("g" if group else "p"), F.lit(np_)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = [right[c].to_numpy() for c in carried]
            found = []
            if len(left) and len(right):
                found = [x for x in pairs(left["q"].to_numpy(), _unit(_matrix(left["v"], dims)), columns, _unit(_matrix(right["v"], dims))) if len(x[0])]
            if not found:
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in ["q", *carried]} | {"sim": np.zeros(0)})
            return pd.DataFrame(dict(zip(["q", *carried, "sim"], (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

        out = qb.groupBy("qb", "pb").cogroup(pb.groupBy("qb", "pb")).applyInPandas(meet, schema)
    names = [F.col("q").alias(query), F.col("p").alias(item if item != query else "other")]
    return out.select(*names, *([F.col("g").alias(group), F.col("o").alias(order)] if group else []), "sim")


def best_per_group(queries: DataFrame, query: str, pool: DataFrame, item: str, group: str, order: str, top: int = 1, **more) -> DataFrame:
    """``query, group, item, order, sim, rank`` of the ``top`` best items of every query and group; ties go to the smaller ``order``.

    Tasks combine first, so at most ``top`` rows a query and group leave each of their batches.
    """
    near = similarities(queries, query, pool, item, top=top, group=group, order=order, **more)
    if top == 1:
        best = F.min(F.struct((-F.col("sim")).alias("s"), order, item))  # a partial aggregate
        one = near.groupBy(query, group).agg(best.alias("b"))
        return one.select(query, group, F.col(f"b.{item}").alias(item), F.col(f"b.{order}").alias(order), (-F.col("b.s")).alias("sim"), F.lit(1).alias("rank"))
    w = Window.partitionBy(query, group).orderBy(F.desc("sim"), order, item)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def knn(queries: DataFrame, query: str, pool: DataFrame, item: str, k: int, **more) -> DataFrame:
    """``query, item, sim, rank`` of the ``k`` most similar items of each query; ties go to the smaller item."""
    near = similarities(queries, query, pool, item, top=k, **more)
    best = Window.partitionBy(query).orderBy(F.desc("sim"), item)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def within_threshold(queries: DataFrame, query: str, pool: DataFrame, item: str, least: float, limit: int = 50, **more) -> DataFrame:
    """Items with a similarity of at least ``least``, best first, ``limit`` of them at most (a feature of the search)."""
    near = similarities(queries, query, pool, item, least=least, **more)
    best = Window.partitionBy(query).orderBy(F.desc("sim"), item)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


# ---------------------------------------------------------------- a table with itself


class _Best:
    """The ``limit`` best pairs of each query of a block: highest score first, then the smaller item."""

    def __init__(self, queries: int, limit: int) -> None:
        self.limit, self.waiting = limit, 0
        self.least, self.last = np.full(queries, -np.inf), np.zeros(queries, np.int64)  # what the last of a full query has
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        better = (s > self.least[q]) | ((s == self.least[q]) & (i < self.last[q]))
        if better.any():
            self.parts.append((q[better], i[better], s[better]))
            self.waiting += len(self.parts[-1][0])
            if self.waiting > WAITING:
                self.rank()

    def rank(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, s = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        n = np.arange(len(q)) - np.searchsorted(q, q)  # before it in its query
        full = n == self.limit - 1
        self.least[q[full]], self.last[q[full]] = s[full], i[full]
        kept = n < self.limit
        self.parts, self.waiting = [(q[kept], i[kept], s[kept])], 0
        return self.parts[0]


def _tiles(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x``, rows of ``y`` and scores of the pairs of unit vectors from ``least`` on, tile by tile; if both are the ``same``, each pair once."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    low = np.float32(least - 1e-5)  # single precision errs by less
    room = np.empty(TILE, np.float32)
    for at in range(0, len(x), TILE[0]):
        a = x32[at : at + TILE[0]]
        for to in range(0, len(y), TILE[1]):
            b = y32[to : to + TILE[1]]
            if same and to + len(b) <= at:
                continue
            s = np.matmul(a, b.T, out=room) if (len(a), len(b)) == room.shape else a @ b.T
            if s.max() < low:
                continue
            r, c = np.divmod(np.flatnonzero(s >= low), len(b))
            many = len(r) > s.size // 64
            exact = (x[at : at + len(a)] @ y[to : to + len(b)].T)[r, c] if many else np.einsum("ij,ij->i", x[at + r], y[to + c])
            exact, r, c = np.round(exact, 9), at + r, to + c
            use = (exact >= least) & ((r < c) | (not same))
            yield r[use], c[use], exact[use]


def earlier_similar(rows: DataFrame, key: str, older: str, at: str, group: str, least: float, limit: int, vector: str = "embedding", dims: int = 64) -> DataFrame:
    """``key, older, sim``: for each row the ``limit`` most similar ones, from ``least`` on, that have a smaller ``at`` and another ``group``.

    Scores are those of ``similarities``, of all pairs; ties go to the smaller key. A key that comes again counts once, at its smallest
    ``at``; rows without key, ``at`` or ``group`` have no pairs. ``at`` is a number. Each two blocks meet once, for both directions,
    and at most ``limit`` rows a query and direction leave their task. What single precision leaves is scored in double precision.
    """
    n = partitions_for(rows.count(), PACKED)
    named = rows.select(F.col(key).cast("string").alias("k"), F.col(at).cast("bigint").alias("t"), F.col(group).cast("string").alias("g"), F.col(vector).alias("v")).where("k is not null")
    once = named.repartition(n, "k").groupBy("k").agg(F.min("t").alias("t"), F.first("g").alias("g"), F.first("v").alias("v"))
    fine = once.where(F.col("t").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dims))
    kind = np.float64 if isinstance(rows.schema[vector].dataType.elementType, DoubleType) else np.float32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            t = pa.Table.from_batches(some).sort_by("k")
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]).astype(kind)
            lists = [pa.array([t.column(c).to_numpy()], pa.list_(of)) for c, of in (("k", pa.string()), ("t", pa.int64()), ("g", pa.string()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], names=["k", "t", "g", "v"])

    blocks = cut(fine.mapInArrow(pack, "k array<string>, t array<bigint>, g array<string>, v binary").withColumn("b", F.spark_partition_id()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row] for c in batch.schema.names}
                ks = [of[c].values for c in ("k", "k2")]
                ts = [of[c].values.to_numpy() for c in ("t", "t2")]
                codes = pa.chunked_array([of["g"].values, of["g2"].values]).combine_chunks().dictionary_encode().indices.to_numpy()
                gs = codes[: len(ks[0])], codes[len(ks[0]) :]
                x, y = (_unit(np.frombuffer(of[c].as_py(), kind).astype(np.float64).reshape(-1, dims)) for c in ("v", "v2"))
                best = _Best(len(x), limit), _Best(len(y), limit)
                for r, c, s in _tiles(x, y, least, of["b"] == of["b2"]):
                    use = gs[0][r] != gs[1][c]
                    r, c, s = r[use], c[use], s[use]
                    later, sooner = ts[0][r] > ts[1][c], ts[0][r] < ts[1][c]
                    best[0].add(r[later], c[later], s[later])
                    best[1].add(c[sooner], r[sooner], s[sooner])
                for b, mine, theirs in zip(best, ks, ks[::-1], strict=True):
                    q, i, s = b.rank()
                    yield pa.RecordBatch.from_arrays([mine.take(pa.array(q)), theirs.take(pa.array(i)), pa.array(s)], names=[key, older, "sim"])

    # of (i, j) and (j, i) one, such that each block is first as often as second
    one = F.when((F.col("b") + F.col("b2")) % 2 == 0, F.col("b") <= F.col("b2")).otherwise(F.col("b") > F.col("b2"))
    both = blocks.hint("shuffle_replicate_nl").join(blocks.withColumnsRenamed({c: f"{c}2" for c in blocks.columns}), one)
    near = both.mapInArrow(meet, f"{key} string, {older} string, sim double")
    w = Window.partitionBy(key).orderBy(F.desc("sim"), older)
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")
