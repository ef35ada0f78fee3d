"""Linking new fake queries to older similar ones: the version graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.functions.vectors import cosine
from mnemospark.operators.hierarchy import components
from mnemospark.operators.similarity import similarities
from mnemospark.session import cut, partitions_for

#: Queries of a component of hits that one task folds; larger components are folded by joins.
MAX_COMPONENT = 200_000
#: Queries that one task folds on average, of many components.
FOLDED = 5_000


def parents(hits: DataFrame, fake_queries: DataFrame, config: Config = Config()) -> DataFrame:
    """``new_id, parent_ids, depth, n_hits`` from ``hits`` (``new_id, query_id, sim``).

    A hit that is a parent of another hit of the same new query is dropped; the best three of
    the rest are the parents, and the depth is one more than the deepest of them (unknown counts as 0).
    """
    known = fake_queries.select("query_id", "parent_ids", F.coalesce("depth", F.lit(0)).alias("depth"))
    h = hits.join(known, "query_id")
    covered = h.select("new_id", F.explode("parent_ids").alias("query_id")).distinct()
    leaves = h.join(covered, ["new_id", "query_id"], "left_anti")
    order = Window.partitionBy("new_id").orderBy(F.desc("sim"), "query_id")
    best = leaves.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.max_parents)
    chosen = best.groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct("n", "query_id"))).alias("p"), (F.max("depth") + 1).alias("depth"))
    count = hits.groupBy("new_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return count.join(chosen, "new_id", "left").select("new_id", F.coalesce(F.transform("p", lambda e: e["query_id"]), F.array().cast("array<string>")).alias("parent_ids"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_hits")


def version_hits(new: DataFrame, fake_queries: DataFrame, config: Config = Config()) -> DataFrame:
    """``new_id, query_id, memory_id, sim, rank``: stored fake queries similar to ``new`` (``new_id, embedding`` and perhaps ``memory_id``).

    Queries of the new one's own memory don't count, nor does one with its own id: a memory that is ingested again replaces
    them, and would otherwise follow itself. At most ``max_hits`` of the others hold, best first.
    """
    near = similarities(new, "new_id", fake_queries, "query_id", least=config.version_threshold)
    near = near.where(F.col("new_id").cast("string") != F.col("query_id")).join(fake_queries.select("query_id", "memory_id"), "query_id")
    if "memory_id" in new.columns:
        near = near.join(new.select("new_id", F.col("memory_id").alias("own")), "new_id").where(~F.col("memory_id").eqNullSafe(F.col("own"))).drop("own")
    best = Window.partitionBy("new_id").orderBy(F.desc("sim"), "query_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.max_hits)


def link_new(new: DataFrame, fake_queries: DataFrame, config: Config = Config()) -> DataFrame:
    """Parents of ``new`` among stored fake queries of other memories; without a hit none, at depth 0."""
    hits = version_hits(new, fake_queries, config)
    found = parents(hits.select("new_id", "query_id", "sim"), fake_queries, config)
    return new.select("new_id").join(found, "new_id", "left").select("new_id", F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def version_graph(queries: DataFrame, hits: DataFrame, config: Config = Config(), max_component: int = MAX_COMPONENT) -> DataFrame:
    """The graph that ingesting sessions one after the other gives: ``query_id, parent_ids, depth``.

    ``queries`` (``query_id, arrival``) and ``hits`` (``query_id, older_id, sim``, at most ``max_hits`` of each
    query, of earlier sessions only) were joined at once, which is the heavy part. What depends on
    the order, pruning by the hits' own parents, is a light fold in order of arrival. It runs for
    each connected component of hits by itself, many to a task, if that has no more than ``max_component`` queries; larger ones are folded
    by joins, a round for each step of the longest chain of hits.
    """
    links = cut(hits.select(F.col("query_id").alias("child"), F.col("older_id").alias("parent")).distinct())
    parts = cut(components(links).select(F.col("node").alias("query_id"), "component"))
    big = cut(parts.groupBy("component").count().where(F.col("count") > max_component).select("component"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "older_id"))).alias("hits"))  # max_hits a query
    rows = queries.select("query_id", "arrival").join(parts, "query_id", "left").join(listed, "query_id", "left")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[str, list[str]] = {}
        depth: dict[str, int] = {}
        now = None
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if r.component != now:
                    above, depth, now = {}, {}, r.component
                found = [h["older_id"] for h in (r.hits if r.hits is not None else [])][: config.max_hits]
                covered = {p for x in found for p in above.get(x, ())}
                chosen = [x for x in found if x not in covered][: config.max_parents]
                above[r.query_id], depth[r.query_id] = chosen, 1 + max((depth.get(x, 0) for x in chosen), default=-1)
                out.append((r.query_id, chosen, depth[r.query_id]))
            yield pd.DataFrame(out, columns=["query_id", "parent_ids", "depth"])

    fits = rows.where("component is not null").join(big, "component", "left_anti")
    whole = fits.repartition(partitions_for(parts.count(), FOLDED), "component").sortWithinPartitions("component", F.asc_nulls_last("arrival"), "query_id")
    linked = whole.mapInPandas(fold, "query_id string, parent_ids array<string>, depth int")
    alone = rows.where("component is null").select("query_id", F.array().cast("array<string>").alias("parent_ids"), F.lit(0).alias("depth"))
    out = linked.unionByName(alone)
    if not big.isEmpty():
        out = out.unionByName(_fold_by_rounds(parts.join(big, "component", "left_semi").select("query_id"), hits, config))
    return out


def _fold_by_rounds(nodes: DataFrame, hits: DataFrame, config: Config) -> DataFrame:
    """The fold by joins: a query is settled once all its hits are, since it depends on nothing else."""
    some = cut(hits.join(nodes, "query_id", "left_semi").select("query_id", "older_id", "sim").distinct())
    nothing = F.array().cast("array<string>")
    left, done = some.select("query_id").distinct(), []
    settled = cut(nodes.join(left, "query_id", "left_anti").select("query_id", nothing.alias("parent_ids"), F.lit(0).alias("depth")))
    while not settled.isEmpty():
        done.append(settled)
        known = reduce(DataFrame.unionByName, done)
        left = cut(left.join(settled, "query_id", "left_anti"))
        waiting = some.join(known.select(F.col("query_id").alias("older_id")), "older_id", "left_anti").select("query_id").distinct()
        ready = left.join(waiting, "query_id", "left_anti")
        found = some.join(ready, "query_id", "left_semi").withColumnsRenamed({"query_id": "new_id", "older_id": "query_id"})
        settled = cut(parents(found, known, config).select(F.col("new_id").alias("query_id"), "parent_ids", F.col("depth").cast("int").alias("depth")))
    return reduce(DataFrame.unionByName, done)


def kp_line(*, prefix: str = "") -> Column:
    """``[time] subject: fact (entities)``."""
    text = lambda c: F.coalesce(F.col(prefix + c), F.lit(""))
    return F.format_string("[%s] %s: %s (%s)", text("time"), text("subject"), text("fact"), text("entities_or_values"))


def gather_linked(new: DataFrame, hits: DataFrame, points: DataFrame, config: Config = Config(), dims: int = 64) -> DataFrame:
    """Facts that a memory's new queries are linked to: ``memory_id, rank, line``, at most ``linked_kp_top_k`` a memory.

    ``new`` (``new_id, memory_id, embedding``), ``hits`` (``new_id, memory_id`` of the older one, ``rank``). A fact's score is its best cosine
    with any new query of the memory, 0 if it has no vector; ties go by first appearance of its memory, then by its index.
    """
    own = new.select("new_id", F.col("memory_id").alias("own"), F.col("embedding").alias("q"))
    seen = hits.join(own.select("new_id", "own"), "new_id").groupBy("own", "memory_id").agg(F.min(F.struct("new_id", "rank")).alias("seen"))
    facts = seen.join(points, "memory_id").select("own", "seen", "memory_id", "kp_index", kp_line().alias("line"), F.col("embedding").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") == dims) & F.col("q").isNotNull() & (F.size("q") == dims)
    best = facts.join(own.drop("new_id"), "own").groupBy("own", "seen", "memory_id", "kp_index", "line").agg(F.max(F.when(fine, F.round(cosine("q", "v"), 9)).otherwise(F.lit(0.0))).alias("score"))
    order = Window.partitionBy("own").orderBy(F.desc("score"), "seen", "memory_id", "kp_index")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.linked_kp_top_k).select(F.col("own").alias("memory_id"), "rank", "line", "score")


def linked_knowledge(hits: DataFrame, points: DataFrame, config: Config = Config()) -> DataFrame:
    """Facts of the memories in a new query's history, in order of first appearance: ``new_id, rank, memory_id, kp_index, line``.

    ``hits`` (``new_id, memory_id, rank``). Facts without vectors tie at score 0, so order decides.
    """
    first = hits.groupBy("new_id", "memory_id").agg(F.min("rank").alias("seen"))
    order = Window.partitionBy("new_id").orderBy("seen", "memory_id", "kp_index")
    ranked = first.join(points, "memory_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.linked_kp_top_k)
    return ranked.select("new_id", "rank", "memory_id", "kp_index", kp_line().alias("line"))


