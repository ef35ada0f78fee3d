import random

import pytest
from pyspark.sql import functions as F

import mnemospark.operators.hierarchy as h

SCHEMA = "id string, parents array<string>, depth int, node string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, p, d, "x", "y") for i, p, d in rows], SCHEMA)


def truth(rows):
    """depth, roots, all paths, descendants, circle and below, by brute force."""
    clean = lambda s: s.strip().lower()
    ids = {clean(i) for i, _, _ in rows if i and clean(i)}
    up = {i: set() for i in ids}
    for i, ps, _ in rows:
        if i and clean(i):
            for p in ps or []:
                up[clean(i)] |= {clean(x) for x in (p or "").split(",")} & ids
    above = {}
    for i in ids:
        seen, todo = set(), list(up[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        above[i] = seen
    circle = {i for i in ids if i in above[i]}
    below = {i for i in ids if above[i] & circle} - circle
    paths = lambda i: [[i]] if not up[i] else [[*p, i] for u in up[i] for p in paths(u)]
    fine = ids - circle - below
    return {i: paths(i) for i in fine}, circle, below, {(a, i) for i in ids for a in above[i]}


def check(spark, rows, **more):
    x = h.hierarchy(table(spark, rows), "id", "parents", "depth", **more)
    paths, circle, below, pairs = truth(rows)
    got = {r["node"]: r for r in x.details().collect()}
    assert {n for n, r in got.items() if r["finding"] == "cycle"} == circle
    assert {n for n, r in got.items() if r["finding"] == "below_cycle"} == below
    for n, r in got.items():
        if r["finding"] == "tree":
            assert r["depth"] == max(map(len, paths[n])) - 1
            assert r["roots"] == sorted({p[0] for p in paths[n]})
            assert r["path"] in paths[n] and len(r["path"]) == r["depth"] + 1
    found = sorted((r["node"], tuple(r["path"])) for r in x.paths().collect())
    assert found == sorted((n, tuple(p)) for n, ps in paths.items() for p in ps if len(p) > 1)
    assert {(r["node"], r["descendant"]) for r in x.descendants().collect()} == pairs
    return x


HAND = [
    ("a", None, 0), ("b", ["a"], 1), ("c", ["a", "b"], 2), ("D", [" C "], 3), ("e", ["B,c", "zz", "", None], 3), ("e", ["B,c"], 3),
    ("p", ["q"], 0), ("q", ["p"], 0), ("r", ["q", "a"], 1), ("s", ["s"], 0), ("t", [], None), (None, ["a"], 1), ("", ["a"], 1),
]


def test_hand_made(spark):
    x = check(spark, HAND)
    nodes = {r["node"]: (r["query_id"], r["stored_depth"]) for r in x.nodes.collect()}
    assert nodes["d"] == ("D", 3) and nodes["t"] == ("t", None) and len(nodes) == 10


def test_empty(spark):
    x = check(spark, [])
    assert x.nodes.count() == 0


@pytest.mark.parametrize(("per", "merged"), [(200_000, 200_000), (15, 200_000), (15, 3)])
def test_random(spark, monkeypatch, per, merged):
    """In one task, in several whose sets are merged in one, and merged by joins."""
    monkeypatch.setattr(h, "LINKS_PER_PARTITION", per)
    monkeypatch.setattr(h, "MERGED_PER_TASK", merged)
    r = random.Random(per)
    rows = [(f"n{i}", [f"n{r.randrange(max(1, i - 12), i + 1)}" for _ in range(r.choice([0, 1, 1, 2]))] if i else [], 0) for i in range(60)]
    rows += [(f"n{i}", [f"n{i + 5}"], 0) for i in (10, 40)]
    check(spark, rows)


def test_large_components_by_joins(spark):
    check(spark, HAND, max_component_links=1)


def test_hub(spark, monkeypatch):
    """A parent of a third of all rows, in many partitions; and a circle far from where its component is marked."""
    monkeypatch.setattr(h, "LINKS_PER_PARTITION", 50)
    monkeypatch.setattr(h, "MERGED_PER_TASK", 4)
    rows = [("hub", None, 0)] + [(f"c{i}", ["hub"], 1) for i in range(400)] + [(f"g{i}", [f"c{i}"], 2) for i in range(400)]
    rows += [(f"x{i}", [f"x{i - 1}" if i else "x199"], 0) for i in range(200)] + [(f"y{i}", [f"x{i}", f"g{i}"], 0) for i in range(0, 200, 40)]
    x = h.hierarchy(table(spark, rows), "id", "parents", "depth")
    found = {r["finding"]: r["n"] for r in x.details().groupBy("finding").agg(F.count("*").alias("n")).collect()}
    assert found == {"tree": 801, "cycle": 200, "below_cycle": 5}
    assert x.links.select("component").distinct().count() == 1


def test_long_chain(spark):
    n = 3_000
    x = h.hierarchy(table(spark, [(f"n{i}", [f"n{i - 1}"] if i else None, i) for i in range(n)]), "id", "parents", "depth")
    assert x.details().where("depth <> cast(substring(node, 2) as int)").count() == 0


def test_weights():
    s = h.WeightedSets()
    s.unite("b", "a", 1)
    s.unite("d", "c", 1)
    s.unite("c", "b", 1)
    assert s.find("d")[1] - s.find("a")[1] == 3 and not s.contradicted
    s.unite("a", "d", 1)
    assert s.contradicted
