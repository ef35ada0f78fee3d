"""Parent-child links to full hierarchies: depth, roots, paths, descendants, circles.

Links are merged by weighted disjoint-set forests. Each partition unites the ends of its own
links, which are cut by child, so a parent of any number of children loads no partition more than others; a node's
weight is its level relative to its set's root. Only nodes that occur in several partitions are passed up, as links between the
roots of their sets. If these fit in one task, it merges them; if not, they are joined to their smallest neighbours, weights
and all, round by round until each set is a star. A link that contradicts the weights of its
set (a circle always does, several parents at different levels may) marks its component.

Whole components are then brought together, many to a partition, and traversed through an
index of parents: components whose weights agree can't hold a circle, so the search for
circles runs only in the others. Components above ``max_component_links`` aren't brought
into one task: they are traversed by joins, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import plain_name
from mnemospark.session import cut, partitions_for

#: Links that one task merges at most, and that it merges or traverses where there are enough of them for all tasks.
MERGED_PER_TASK, LINKS_PER_PARTITION = 200_000, 20_000
#: Components with more links are traversed by joins instead of in one task.
MAX_COMPONENT_LINKS = 400_000


@dataclass
class Hierarchy:
    """Nodes (``node, query_id, stored_depth``), links with their component, and the parameters."""

    nodes: DataFrame
    links: DataFrame
    large: DataFrame | None

    def details(self) -> DataFrame:
        """Per node that has a parent or child: ``node, depth, roots, path, finding``."""
        n = partitions_for(self.links.count(), LINKS_PER_PARTITION)
        out = self.links.repartition(n, "component").mapInPandas(_node_details, "node string, depth int, roots array<string>, path array<string>, finding string")
        return out if self.large is None else out.unionByName(_large_details(self.large))

    def paths(self) -> DataFrame:
        """``node, path``: every path from a root to a node that has parents."""
        n = partitions_for(self.links.count(), LINKS_PER_PARTITION)
        out = self.links.repartition(n, "component").mapInPandas(_node_paths, "node string, path array<string>")
        return out if self.large is None else out.unionByName(_large_paths(self.large))

    def descendants(self) -> DataFrame:
        """``node, descendant, steps``: every pair, with the fewest links between them."""
        n = partitions_for(self.links.count(), LINKS_PER_PARTITION)
        out = self.links.repartition(n, "component").mapInPandas(_node_descendants, "node string, descendant string, steps int")
        return out if self.large is None else out.unionByName(_closure(self.large).select("node", "descendant", "steps"))


# ---------------------------------------------------------------- weighted disjoint sets


class WeightedSets:
    """Disjoint sets whose members know their level relative to the root of their set."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}
        self.weight: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.contradicted: set[str] = set()

    def find(self, x: str) -> tuple[str, int]:
        """The root of ``x`` and the level of ``x`` relative to it."""
        up, weight = self.up, self.weight
        if x not in up:
            up[x], weight[x], self.rank[x] = x, 0, 0
            return x, 0
        trail = []
        while up[x] != x:
            trail.append(x)
            x = up[x]
        total = 0
        for y in reversed(trail):
            total += weight[y]
            up[y], weight[y] = x, total
        return x, total

    def unite(self, child: str, parent: str, levels: int) -> None:
        """``child`` is ``levels`` below ``parent``."""
        (a, wa), (b, wb) = self.find(child), self.find(parent)
        if a == b:
            if wa != wb + levels:
                self.contradicted.add(a)
            return
        shift = wb + levels - wa  # level of a relative to b
        if self.rank[a] > self.rank[b]:
            a, b, shift = b, a, -shift
        self.up[a], self.weight[a] = b, shift
        self.rank[b] += self.rank[a] == self.rank[b]
        if a in self.contradicted:
            self.contradicted.add(b)


_SETS = "node string, root string, levels bigint, contradicted boolean"


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(child, parent, levels, contradicted) of a partition to each end's root there."""
    sets = WeightedSets()
    for frame in frames:
        for child, parent, levels, bad in zip(frame["child"], frame["parent"], frame["levels"], frame["contradicted"], strict=True):
            sets.unite(child, parent, levels)
            if bad:
                sets.contradicted.add(sets.find(child)[0])
    names, rows = list(sets.up), []
    bad = {sets.find(x)[0] for x in sets.contradicted}
    for x in names:
        root, level = sets.find(x)
        rows.append((x, root, level, root in bad))
        if len(rows) == 50_000:
            yield pd.DataFrame(rows, columns=["node", "root", "levels", "contradicted"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["node", "root", "levels", "contradicted"])


def components(links: DataFrame) -> DataFrame:
    """``node, component, contradicted`` for every end of ``links`` (``child, parent``)."""
    now = links.select("child", "parent", F.lit(1).cast("bigint").alias("levels"), F.lit(False).alias("contradicted"))
    n = partitions_for(links.count(), LINKS_PER_PARTITION)
    sets = cut(now.repartition(n, "child").mapInPandas(_merge, _SETS))
    final = sets.groupBy("node").agg(F.min("root").alias("component"), F.max("contradicted").alias("contradicted"))
    if n == 1:
        return final
    # a node occurs once per partition, so at most n times
    w = Window.partitionBy("node").orderBy("root")
    shared = sets.withColumn("first", F.first("root").over(w)).withColumn("at", F.first("levels").over(w)).where("root <> first")
    # root is (at - levels) below first: level(node) = levels + level(root) = at + level(first)
    up = cut(shared.select(F.col("root").alias("child"), F.col("first").alias("parent"), (F.col("at") - F.col("levels")).alias("levels")).distinct())
    left = up.count()
    if left <= MERGED_PER_TASK:
        higher = up.withColumn("contradicted", F.lit(False)).repartition(1).mapInPandas(_merge, _SETS)
    else:
        higher = _stars(up)
    higher = higher.select(F.col("node").alias("component"), F.col("root").alias("above"), F.col("contradicted").alias("bad"))
    # a component is contradicted if any set of it, or any link between its sets, is
    mapped = final.join(higher, "component", "left").select("node", F.coalesce("above", "component").alias("component"), (F.col("contradicted") | F.coalesce("bad", F.lit(False))).alias("contradicted"))
    bad = sets.where("contradicted").select(F.col("root").alias("component")).distinct().join(higher, "component", "left").select(F.coalesce("above", "component").alias("component")).distinct()
    return mapped.join(bad.withColumn("marked", F.lit(True)), "component", "left").select("node", "component", (F.col("contradicted") | F.coalesce("marked", F.lit(False))).alias("contradicted"))


def _stars(links: DataFrame) -> DataFrame:
    """``node, root, levels, contradicted`` of links (``child, parent, levels``) too many for one task.

    In turns, a node's larger and its smaller neighbours are linked to the smallest of all, until every set is a
    star around its smallest node. What is joined is bounded by the links; the join's hot keys are split by the engine.
    """
    now = links.select(F.col("child").alias("u"), F.col("parent").alias("v"), F.col("levels").alias("d"))
    bad, before = None, None
    while True:
        for larger in (True, False):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("d")).alias("d")))
            best = both.groupBy("u").agg(F.min(F.struct("v", "d")).alias("b")).select("u", F.when(F.col("b.v") < F.col("u"), F.col("b.v")).otherwise(F.col("u")).alias("m"), F.when(F.col("b.v") < F.col("u"), F.col("b.d")).otherwise(F.lit(0)).alias("dm"))
            # level(v) = level(u) - d = level(m) + dm - d
            side = both.join(best, "u").where(F.col("v") > F.col("u") if larger else F.col("v") <= F.col("u"))
            moved = side.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("dm") - F.col("d")).alias("d"))
            if not larger:
                moved = moved.unionByName(best.where("m < u").select("u", F.col("m").alias("v"), F.col("dm").alias("d")))
            pairs = cut(moved.groupBy("u", "v").agg(F.min("d").alias("d"), F.max("d").alias("most")))
            wrong = pairs.where((F.col("d") != F.col("most")) | ((F.col("u") == F.col("v")) & (F.col("d") != 0))).select("u").distinct()
            bad = wrong if bad is None else bad.unionByName(wrong)
            now = pairs.where("u <> v").select("u", "v", "d")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"), F.col("d").alias("levels"))
    all_ = cut(stars.unionByName(stars.select(F.col("root").alias("node"), "root", F.lit(0).cast("bigint").alias("levels")).distinct()))
    marked = bad.distinct().join(all_.select(F.col("node").alias("u"), "root"), "u").select("root").distinct().withColumn("contradicted", F.lit(True))
    return all_.join(marked, "root", "left").select("node", "root", "levels", F.coalesce("contradicted", F.lit(False)).alias("contradicted"))


def hierarchy(df: DataFrame, node: str, parents: str, depth: str | None = None, max_component_links: int = MAX_COMPONENT_LINKS) -> Hierarchy:
    """Nodes and links of a table with an id, an array of parent ids and perhaps a stored depth.

    Ids are compared in lower case and without blanks around them. An element of
    ``parents`` may name several ids, separated by commas; null, empty and unknown ids name
    nobody. Rows without an id are left out. Of repeated rows the parents are united and
    the largest stored depth holds; ``query_id`` is the smallest spelling of the id. A node
    that names itself is a circle of one. An empty table gives empty results.
    """
    stored = F.col(depth) if depth else F.lit(None)
    rows = df.select(plain_name(node).alias("node"), F.col(node).alias("spelt"), F.col(parents).alias("named"), stored.cast("int").alias("stored")).where("node is not null and node <> ''")
    nodes = rows.groupBy("node").agg(F.min("spelt").alias("query_id"), F.max("stored").alias("stored_depth"))
    named = rows.select("node", F.explode("named").alias("one")).select(F.col("node").alias("child"), F.explode(F.split("one", ",")).alias("one"))
    named = named.select("child", plain_name("one").alias("parent")).where("parent <> ''").distinct()
    links = cut(named.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("child", "parent"))
    parts = components(links)
    at = cut(links.join(parts, links["child"] == parts["node"]).select("component", "contradicted", "child", "parent"))
    sizes = at.groupBy("component").count().where(F.col("count") > max_component_links)
    large = None
    if not sizes.isEmpty():
        large, at = at.join(sizes, "component", "left_semi"), at.join(sizes, "component", "left_anti")
    return Hierarchy(nodes, at, large)


# ---------------------------------------------------------------- traversal of whole components


class _Index:
    """Nodes of a partition's components as numbers, with their parents and children."""

    def __init__(self, frames: Iterator[pd.DataFrame]) -> None:
        frames = [x for x in frames if len(x)]
        self.empty = not frames
        if self.empty:
            return
        all_ = pd.concat(frames, ignore_index=True)
        codes, names = pd.factorize(pd.concat([all_["child"], all_["parent"]], ignore_index=True))
        self.names: list[str] = list(names)
        n, m = len(names), len(all_)
        self.parents: list[list[int]] = [[] for _ in range(n)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for child, parent in zip(codes[:m].tolist(), codes[m:].tolist(), strict=True):
            self.parents[child].append(parent)
            self.children[parent].append(child)
        suspect = set(codes[:m][all_["contradicted"].to_numpy(bool)].tolist())
        waiting = [len(x) for x in self.parents]
        order = [x for x in range(n) if not waiting[x]]
        for x in order:
            for y in self.children[x]:
                waiting[y] -= 1
                if not waiting[y]:
                    order.append(y)
        self.order = order
        self.depth = [0] * n
        for x in order:
            if self.parents[x]:
                self.depth[x] = 1 + max(self.depth[p] for p in self.parents[x])
        rest = {x for x in range(n) if waiting[x]}
        assert not rest or suspect, "a circle in a component without contradiction"
        self.circle = self._circles(rest)
        self.below = rest - self.circle

    def _circles(self, rest: set[int]) -> set[int]:
        """Members of circles among ``rest``: strongly connected components above one node, and self-links."""
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        on, stack, found = set(), [], set()
        for start in rest:
            if start in index:
                continue
            work = [(start, iter(self.children[start]))]
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
            while work:
                x, edges = work[-1]
                for y in edges:
                    if y not in rest:
                        continue
                    if y not in index:
                        index[y] = low[y] = len(index)
                        stack.append(y)
                        on.add(y)
                        work.append((y, iter(self.children[y])))
                        break
                    if y in on:
                        low[x] = min(low[x], index[y])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[x])
                    if low[x] == index[x]:
                        group = []
                        while True:
                            y = stack.pop()
                            on.discard(y)
                            group.append(y)
                            if y == x:
                                break
                        if len(group) > 1 or x in self.children[x]:
                            found.update(group)
        return found


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def _node_details(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    g = _Index(frames)
    if g.empty:
        return

    def rows() -> Iterator[tuple]:
        names, left = g.names, [len(x) for x in g.children]
        roots: dict[int, frozenset[int]] = {}
        paths: dict[int, list[str]] = {}
        for x in g.order:
            above = g.parents[x]
            if above:
                sets = {roots[p] for p in above}
                roots[x] = next(iter(sets)) if len(sets) == 1 else frozenset().union(*sets)
                deepest = min(above, key=lambda p: (-g.depth[p], names[p]))
                paths[x] = [*paths[deepest], names[x]]
            else:
                roots[x], paths[x] = frozenset([x]), [names[x]]
            yield names[x], g.depth[x], sorted(names[r] for r in roots[x]), paths[x], "tree"
            for p in above:  # nothing below needs them any more
                left[p] -= 1
                if not left[p]:
                    del roots[p], paths[p]
        for x in g.circle:
            yield names[x], None, None, None, "cycle"
        for x in g.below:
            yield names[x], None, None, None, "below_cycle"

    for frame in _frames(rows(), ["node", "depth", "roots", "path", "finding"]):
        yield frame.assign(depth=frame["depth"].astype("Int32"))


def _node_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    g = _Index(frames)
    if g.empty:
        return

    def rows() -> Iterator[tuple]:
        for x in g.order:
            if not g.parents[x]:
                continue
            trail, work = [x], [iter(g.parents[x])]
            while work:
                p = next(work[-1], None)
                if p is None:
                    work.pop()
                    trail.pop()
                elif g.parents[p]:
                    trail.append(p)
                    work.append(iter(g.parents[p]))
                else:
                    yield g.names[x], [g.names[p], *(g.names[y] for y in reversed(trail))]

    yield from _frames(rows(), ["node", "path"])


def _node_descendants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    g = _Index(frames)
    if g.empty:
        return

    def rows() -> Iterator[tuple]:
        for x, name in enumerate(g.names):
            seen, level, steps = set(), g.children[x], 0
            while level:
                steps += 1
                new = {y for y in level if y not in seen}
                seen |= new
                for y in new:
                    yield name, g.names[y], steps
                level = [z for y in new for z in g.children[y]]

    yield from _frames(rows(), ["node", "descendant", "steps"])


# ---------------------------------------------------------------- components too large for one task


def _closure(links: DataFrame) -> DataFrame:
    """Every (node, descendant) of ``links`` with the fewest steps, one join per step."""
    edges = cut(links.select(F.col("parent").alias("node"), F.col("child").alias("descendant")))
    step = edges.withColumnRenamed("node", "via").withColumnRenamed("descendant", "next")
    all_ = new = cut(edges.distinct().withColumn("steps", F.lit(1)))
    while not new.isEmpty():
        ahead = new.join(step, new["descendant"] == step["via"]).select("node", F.col("next").alias("descendant"), (F.col("steps") + 1).alias("steps")).distinct()
        new = cut(ahead.join(all_, ["node", "descendant"], "left_anti"))
        all_ = cut(all_.unionByName(new))
    return all_


def _trimmed(edges: DataFrame) -> DataFrame:
    """Links that lie on a circle or between two: ends without parents or children are taken off until there are none."""
    now, before = cut(edges), -1
    left = now.count()
    while left != before:
        before = left
        above = now.select(F.col("child").alias("parent")).distinct()  # those that have a parent
        below = now.select(F.col("parent").alias("child")).distinct()  # those that have a child
        now = cut(now.join(above, "parent", "left_semi").join(below, "child", "left_semi"))
        left = now.count()
    return now


def _large_levels(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, depth`` of those neither in nor below a circle, ``node, finding`` of the rest), a level a round."""
    edges = cut(links.select("child", "parent").distinct())
    names = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    done = cut(names.join(edges.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    levels, left, depth = [done], edges, 0
    while not done.isEmpty():
        depth += 1
        left = cut(left.join(done.select(F.col("node").alias("parent")), "parent", "left_anti"))
        reached = reduce(DataFrame.unionByName, levels)
        ready = names.join(reached, "node", "left_anti").join(left.select(F.col("child").alias("node")), "node", "left_anti")
        done = cut(ready.withColumn("depth", F.lit(depth)))
        levels.append(done)
    reached = cut(reduce(DataFrame.unionByName, levels))
    rest = edges.join(reached.select(F.col("node").alias("child")), "child", "left_anti").join(reached.select(F.col("node").alias("parent")), "parent", "left_anti")
    circle = _closure(_trimmed(rest)).where("node = descendant").select("node").distinct().withColumn("on", F.lit(True))
    others = names.join(reached, "node", "left_anti").join(circle, "node", "left")
    return reached, others.select("node", F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("finding"))


def _large_roots(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """``node, roots``: pairs of a node and a root, passed down a link a round; what is made is no more than what comes out."""
    new = all_ = cut(reached.where("depth = 0").select("node", F.col("node").alias("root")))
    inner = cut(edges.join(reached.select(F.col("node").alias("child")), "child", "left_semi"))
    while not new.isEmpty():
        ahead = inner.join(new.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "root").distinct()
        new = cut(ahead.join(all_, ["node", "root"], "left_anti"))
        all_ = cut(all_.unionByName(new))
    return all_.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots"))


def _large_details(links: DataFrame) -> DataFrame:
    reached, others = _large_levels(links)
    edges = links.select("child", "parent").distinct()
    roots = _large_roots(edges, reached)
    first = Window.partitionBy("child").orderBy(F.desc("depth"), "parent")
    via = cut(edges.join(reached.withColumnRenamed("node", "parent"), "parent").withColumn("n", F.row_number().over(first)).where("n = 1").select("child", "parent"))
    now, done = reached.select("node", F.col("node").alias("top"), F.array("node").alias("path")), []
    while not now.isEmpty():
        ahead = now.join(via, now["top"] == via["child"], "left")
        done.append(cut(ahead.where("parent is null").select("node", "path")))
        now = cut(ahead.where("parent is not null").select("node", F.col("parent").alias("top"), F.concat(F.array("parent"), "path").alias("path")))
    paths = reduce(DataFrame.unionByName, done) if done else reached.select("node", F.array("node").alias("path"))
    tree = reached.join(roots, "node", "left").join(paths, "node", "left")
    tree = tree.select("node", "depth", F.coalesce("roots", F.array("node")).alias("roots"), "path", F.lit("tree").alias("finding"))
    empty = F.lit(None).cast("array<string>")
    return tree.unionByName(others.select("node", F.lit(None).cast("int").alias("depth"), empty.alias("roots"), empty.alias("path"), "finding"))


def _large_paths(links: DataFrame) -> DataFrame:
    reached, _ = _large_levels(links)
    edges = cut(links.select("child", "parent").distinct())
    now = reached.where("depth > 0").select("node", F.col("node").alias("top"), F.array("node").alias("path"))
    done = []
    while not now.isEmpty():
        ahead = now.join(edges, now["top"] == edges["child"], "left")
        done.append(cut(ahead.where("parent is null").select("node", "path")))
        now = cut(ahead.where("parent is not null").select("node", F.col("parent").alias("top"), F.concat(F.array("parent"), "path").alias("path")))
    return reduce(DataFrame.unionByName, done) if done else now.select("node", "path")
