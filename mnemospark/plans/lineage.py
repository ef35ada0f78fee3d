"""Queries of problem 5 over fake_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.hierarchy import Hierarchy, hierarchy


def _of(spark: SparkSession, sf: str) -> Hierarchy:
    return hierarchy(spark.read.parquet(f"{sf}/fake_queries.parquet").select("query_id", "parent_ids", "depth"), "query_id", "parent_ids", "depth")


def p5_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: true and stored depth, roots, one deepest path (ids joined by ``,`` and `` > ``), and whether it is in or below a circle."""
    h = _of(spark, sf)
    alone = F.coalesce("finding", F.lit("tree")) == "tree"
    return h.nodes.join(h.details(), "node", "left").select(
        "query_id", "stored_depth",
        F.when(alone, F.coalesce("depth", F.lit(0))).alias("true_depth"),
        F.when(alone, F.array_join(F.coalesce("roots", F.array("node")), ",")).alias("roots"),
        F.when(alone, F.array_join(F.coalesce("path", F.array("node")), " > ")).alias("path"),
        F.coalesce("finding", F.lit("tree")).alias("finding"),
    )


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path from a root down to each query; a query without parents is its own path."""
    h = _of(spark, sf)
    whole = h.details().where("finding <> 'tree'").select("node", F.lit(True).alias("out"))
    paths = h.nodes.join(h.paths(), "node", "left").join(whole, "node", "left").where("out is null")
    return paths.select("query_id", F.array_join(F.coalesce("path", F.array("node")), " > ").alias("path"))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with each of its descendants and the fewest links between them."""
    h = _of(spark, sf)
    lower = h.nodes.select(F.col("node").alias("descendant"), F.col("query_id").alias("descendant_id"))
    return h.descendants().join(h.nodes, "node").join(lower, "descendant").select("query_id", "descendant_id", "steps")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Queries in a circle, and queries whose stored depth is wrong."""
    h = p5_hierarchy(spark, sf)
    finding = F.when(F.col("finding") == "cycle", "cycle").when((F.col("finding") == "tree") & (F.col("stored_depth") != F.col("true_depth")), "depth")
    return h.select("query_id", finding.alias("finding")).where("finding is not null")


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_LINKS = """
links_raw as (select distinct lower(trim(query_id)) child, lower(trim(x)) parent from fake_queries, unnest(parent_ids) u(p), unnest(string_split(p, ',')) v(x)),
nodes as (select lower(trim(query_id)) node, min(query_id) query_id, max(depth) stored_depth from fake_queries where query_id is not null group by 1),
links as (select child, parent from links_raw where parent <> '' and parent in (select node from nodes)),
above as (select child, parent ancestor from links union select a.child, l.parent from above a join links l on l.child = a.ancestor),
circle as (select distinct child node from above where child = ancestor),
bad as (select node from circle union select child from above where ancestor in (select node from circle))
"""

_DEPTHS = """
walk as (select node, 0 d from nodes where node not in (select child from links)
  union select l.child, w.d + 1 from walk w join links l on l.parent = w.node where l.child not in (select node from bad)),
depths as (select node, max(d) true_depth from walk group by node)
"""

ORACLES = {
    "p5_found": f"""with recursive {_LINKS}, {_DEPTHS}
select query_id, 'cycle' finding from nodes where node in (select node from circle)
union all select query_id, 'depth' from nodes join depths using (node) where stored_depth <> true_depth and node not in (select node from bad)""",
    "p5_hierarchy": f"""with recursive {_LINKS}, {_DEPTHS},
best as (select child, parent from (select child, parent, row_number() over (partition by child order by true_depth desc, parent) n from links join depths on depths.node = parent where child not in (select node from bad)) where n = 1),
way as (select node, node path from nodes where node not in (select child from links) union all select b.child, w.path || ' > ' || b.child from way w join best b on b.parent = w.node),
tops as (select child node, string_agg(distinct ancestor, ',' order by ancestor) roots from above where ancestor not in (select child from links) group by 1)
select query_id, cast(stored_depth as int) stored_depth, case when b.node is null then cast(true_depth as int) end true_depth, case when b.node is null then coalesce(roots, nodes.node) end roots, case when b.node is null then path end path,
case when nodes.node in (select node from circle) then 'cycle' when b.node is not null then 'below_cycle' else 'tree' end finding
from nodes left join depths on depths.node = nodes.node left join (select distinct node from bad) b on b.node = nodes.node left join tops on tops.node = nodes.node left join way on way.node = nodes.node""",
    "p5_paths": f"""with recursive {_LINKS},
way as (select node, node path from nodes where node not in (select child from links) union all select l.child, w.path || ' > ' || l.child from way w join links l on l.parent = w.node where l.child not in (select node from bad))
select query_id, path from way join nodes using (node)""",
    "p5_descendants": """with recursive
links_raw as (select distinct lower(trim(query_id)) child, lower(trim(x)) parent from fake_queries, unnest(parent_ids) u(p), unnest(string_split(p, ',')) v(x)),
nodes as (select lower(trim(query_id)) node, min(query_id) query_id from fake_queries where query_id is not null group by 1),
links as (select child, parent from links_raw where parent <> '' and parent in (select node from nodes)),
walk as (select parent node, child descendant, 1 steps from links
  union select w.node, l.child, w.steps + 1 from walk w join links l on l.parent = w.descendant where w.steps < 400)
select a.query_id, b.query_id descendant_id, cast(min(steps) as int) steps
from walk join nodes a using (node) join nodes b on b.node = walk.descendant group by all""",
}
