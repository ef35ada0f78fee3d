"""Analyses of representations: alignment, paired statistics, robustness, ranks, drift, agreement of clusterings.

All start from one relation of similarities (``query, method, session, pos, sim``) of true queries
and stored vectors, and from ``evidence`` (``query, ev_pos, session``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemospark.functions import stats

#: Sessions from which one without evidence is drawn, at most.
NEGATIVES = 256
METHODS = ("q2q", "q2p", "q2n", "q2r", "q2c")


def max_sims(sims: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the best similarity and its first position: partial aggregates, no sort."""
    best = F.max(F.struct("sim", (-F.col("pos")).alias("p")))
    return sims.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.sim").alias("best"), (-F.col("b.p")).alias("best_pos"))


def alignment(sims: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row per query: every method's best similarity in the evidence session that q2q likes best.

    Only sessions with both q2q and q2c vectors count; a method without vectors there gets 0.
    """
    best = max_sims(sims.join(evidence, ["query", "session"]), ["query", "session", "ev_pos", "method"])
    wide = best.groupBy("query", "session", "ev_pos").agg(*[F.max(F.when(F.col("method") == m, F.col("best"))).alias(m) for m in METHODS])
    order = Window.partitionBy("query").orderBy(F.desc("q2q"), "ev_pos")
    one = wide.where("q2q is not null and q2c is not null").withColumn("n", F.row_number().over(order)).where("n = 1")
    return one.select("query", "session", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METHODS], (F.col("q2q") - F.col("q2c")).alias("gap"))


def _paired(a: Column, b: Column) -> list[Column]:
    d = a - b
    n = F.count(F.lit(1))
    sd = F.stddev_samp(d)
    return [
        n.alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_pop(a).alias("std_a"), F.stddev_pop(b).alias("std_b"),
        F.avg(d).alias("gap_mean"), F.stddev_pop(d).alias("gap_std"), F.median(d).alias("gap_median"),
        F.when(sd > 0, F.avg(d) / (sd / F.sqrt(n))).alias("t"), F.when(n > 1, F.avg(d) / (sd + 1e-10)).alias("cohens_d"),
        F.sum((d > 0).cast("int")).alias("wins"), F.sum((d < 0).cast("int")).alias("losses"), F.sum((d == 0).cast("int")).alias("ties"),
    ]


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else stats.t_two_sided(float(x), int(k) - 1) for x, k in zip(t, n, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else stats.chi2_tail(float(v), int(n) - 1) for v, n in zip(x, k, strict=True)], dtype=float)


def paired(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Paired statistics of two columns, over all rows or by a category (null: ``unknown``), with ``p`` of the two-sided t test."""
    columns = _paired(F.col(a), F.col(b))
    out = df.agg(*columns) if by is None else df.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(*columns)
    return out.withColumn("p", _t_p("t", "n"))


def pairwise(aligned: DataFrame) -> DataFrame:
    """Paired statistics of every two methods, in the order of the methods."""
    pairs = F.array(*[F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in combinations(METHODS, 2)])
    out = aligned.select(F.explode(pairs).alias("p")).select("p.*").groupBy("method_a", "method_b").agg(*_paired(F.col("a"), F.col("b")))
    return out.withColumn("p", _t_p("t", "n"))


def describe_methods(aligned: DataFrame) -> DataFrame:
    long = aligned.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("sim")) for m in METHODS])).alias("p")).select("p.*")
    return long.groupBy("method").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.median("sim").alias("median"))


def hit_at_k(sims: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with an evidence session among the first k sessions by their best vector; the pool is evidence sessions."""
    pool = evidence.select("session").distinct()
    best = max_sims(sims.join(pool, "session", "left_semi"), ["query", "method", "session"])
    order = Window.partitionBy("query", "method").orderBy(F.desc("best"), "session")
    ranked = best.withColumn("rank", F.row_number().over(order)).join(evidence.select("query", "session", F.lit(1).alias("hit")).distinct(), ["query", "session"], "left")
    first = ranked.groupBy("query", "method").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return first.groupBy("method").agg(*[F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")).alias(f"hit_{k}") for k in ks], F.count(F.lit(1)).alias("n"))


def discriminability(sims: DataFrame, evidence: DataFrame, sessions: DataFrame) -> DataFrame:
    """Best similarity in the first evidence session less that in one other session.

    The other is drawn, by a hash of both ids, from at most ``NEGATIVES`` sessions, the first by a hash of theirs; a query whose evidence is all of these has none.
    """
    first = Window.partitionBy("query").orderBy("ev_pos")
    positive = evidence.withColumn("n", F.row_number().over(first)).where("n = 1").select("query", F.col("session").alias("positive"))
    targets = evidence.select("query", "session")
    pick = F.md5(F.concat_ws("|", F.col("query").cast("string"), F.col("session").cast("string")))
    some = sessions.select("session").distinct().orderBy(F.md5(F.col("session").cast("string"))).limit(NEGATIVES)
    others = positive.select("query").crossJoin(F.broadcast(some)).join(targets, ["query", "session"], "left_anti").groupBy("query").agg(F.min(F.struct(pick.alias("h"), "session")).alias("m")).select("query", F.col("m.session").alias("negative"))
    best = max_sims(sims, ["query", "method", "session"])
    p = positive.join(best.withColumnRenamed("session", "positive").withColumnRenamed("best", "p"), ["query", "positive"]).select("query", "method", "p")
    n = others.join(best.withColumnRenamed("session", "negative").withColumnRenamed("best", "q"), ["query", "negative"]).select("query", "method", "q")
    d = p.join(n, ["query", "method"], "full").select("method", (F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))).alias("d"))
    return d.groupBy("method").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.median("d").alias("median"), F.avg((F.col("d") > 0).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def robustness(original: DataFrame, styled: DataFrame) -> DataFrame:
    """Per query and method: variance over styles, and 1 less the largest relative drop (``original``: query, method, orig; ``styled``: query, method, style, sim)."""
    each = styled.groupBy("query", "method").agg(F.var_pop("sim").alias("var"), F.min("sim").alias("least"))
    return original.join(each, ["query", "method"]).select("query", "method", "orig", "var", (1 - F.greatest(F.lit(0.0), F.col("orig") - F.col("least")) / (F.col("orig") + 1e-10)).alias("robustness"))


def robustness_summary(each: DataFrame) -> DataFrame:
    """Over queries, from ``robustness``: a row with each method's mean variance, mean and deviation of robustness, and how many
    times q2c varies as much as q2q."""
    per = each.groupBy("method").agg(F.avg("var").alias("mean_var"), F.avg("robustness").alias("mean_robustness"), F.stddev_pop("robustness").alias("std_robustness"))
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("mean_var"))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  a row a method
    return per.withColumn("q2c_over_q2q", of("q2c") / (of("q2q") + 1e-10))


def style_drops(original: DataFrame, styled: DataFrame, styles: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per method, style and over all styles (style null): mean similarity, mean drop, share below ``threshold`` times the original. A missing style counts as 0."""
    grid = original.crossJoin(F.broadcast(styles.select("style").distinct()))  # a handful of styles
    all_ = grid.join(styled, ["query", "method", "style"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    cols = [F.avg("sim").alias("mean_sim"), F.avg(F.col("orig") - F.col("sim")).alias("mean_drop"), F.avg((F.col("sim") < threshold * F.col("orig")).cast("double")).alias("drop_rate"), F.count(F.lit(1)).alias("n")]
    return all_.rollup("method", "style").agg(*cols).where("method is not null")


def friedman(styled: DataFrame, least: int = 10) -> DataFrame:
    """Friedman's chi-squared over styles per method, with average ranks and tie correction; null under ``least`` rows or without any difference."""
    w = Window.partitionBy("method", "query")
    tie = Window.partitionBy("method", "query", "sim")
    r = styled.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("t", F.count(F.lit(1)).over(tie)).withColumn("r", F.rank().over(w.orderBy("sim")) + (F.col("t") - 1) / 2.0)
    sums = r.groupBy("method", "style").agg(F.sum("r").alias("rs"))
    shape = r.groupBy("method").agg(F.countDistinct("query").alias("n"), F.max("k").alias("k"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("tied"))  # sum over members of t^2 - 1 is the sum over ties of t^3 - t
    c = 1 - F.col("tied") / (F.col("n") * F.col("k") * (F.col("k") * F.col("k") - 1))
    chi = (12.0 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("ss") - 3.0 * F.col("n") * (F.col("k") + 1)) / c
    return sums.groupBy("method").agg(F.sum(F.col("rs") * F.col("rs")).alias("ss")).join(shape, "method").select("method", "n", "k", F.when((F.col("n") >= least) & (c > 0), chi).alias("chi2")).withColumn("p", _chi2_p("chi2", "k"))


def checkpoints(n: int) -> list[int]:
    """Every tenth of ``n`` and ``n`` itself; [1] for 1, nothing for 0."""
    step = max(1, n // 10)
    return sorted({*range(step, n, step), n}) if n else []


def drift(sims: DataFrame, evidence: DataFrame, vectors: DataFrame, arrival: DataFrame, points: list[int]) -> DataFrame:
    """Ranks of the first evidence vector as the pool grows: per checkpoint and method mean and median rank, MRR, recall@1/5/10 and drift, and the vectors there are.

    ``vectors`` (``method, session``) are all that is stored, ``arrival`` (``session, seq`` from 1). A query counts once all its evidence is in the pool. The
    rank is one more than the number of vectors above the best evidence vector, so nothing is
    sorted; without an evidence vector it is the size of the pool (in vectors, or sessions if there is none). A checkpoint at which no query
    counts, or q2q or q2c have no vector yet, has 0 queries and no figures; drift is the distance from the first one that has some.
    """
    spark = sims.sparkSession
    cps = F.broadcast(spark.createDataFrame([(int(c),) for c in points], "cp int"))  # at most eleven
    methods = F.broadcast(spark.createDataFrame([(m,) for m in METHODS], "method string"))
    stored = vectors.join(arrival, "session").groupBy("method", "seq").agg(F.count(F.lit(1)).alias("v")).join(cps, F.col("seq") <= F.col("cp")).groupBy("cp", "method").agg(F.sum("v").alias("n_vectors"))
    frame = cps.crossJoin(methods).join(stored, ["cp", "method"], "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))
    full = frame.where("method in ('q2q', 'q2c') and n_vectors > 0").groupBy("cp").count().where("count = 2").select("cp")
    last = evidence.join(arrival, "session", "left").groupBy("query").agg(F.max(F.coalesce("seq", F.lit(1 << 30))).alias("seq"))
    eligible = last.join(cps, F.col("seq") <= F.col("cp")).select("query", "cp").join(full, "cp", "left_semi")
    hit = evidence.select("query", "session", F.lit(True).alias("hit")).distinct()
    s = sims.join(arrival, "session").join(hit, ["query", "session"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    target = s.where("hit").groupBy("query", "method").agg(F.max("sim").alias("target"))
    # all evidence of an eligible query is in the pool, so its best evidence vector doesn't depend on the checkpoint
    above = s.join(target, ["query", "method"], "left").groupBy("query", "method", "seq").agg(F.sum((F.col("sim") > F.col("target")).cast("int")).alias("above"), F.count(F.lit(1)).alias("vectors"), F.max("target").alias("target"))
    rank = F.when(F.max("target").isNull(), F.sum("vectors")).otherwise(F.sum("above") + 1)
    ranks = above.join(cps, F.col("seq") <= F.col("cp")).groupBy("cp", "query", "method").agg(rank.cast("double").alias("rank"))
    grid = eligible.crossJoin(methods)
    each = grid.join(ranks, ["cp", "query", "method"], "left").withColumn("rank", F.coalesce("rank", F.col("cp").cast("double")))
    out = each.groupBy("cp", "method").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)])
    out = frame.join(out, ["cp", "method"], "left").withColumn("n_queries", F.coalesce("n_queries", F.lit(0)))
    return out.withColumn("rank_drift", F.col("mean_rank") - F.first("mean_rank", ignorenulls=True).over(Window.partitionBy("method").orderBy("cp")))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c2 = lambda x: x * (x - 1) / 2
    total = cells.agg(F.sum("n").alias("t"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("n")), cells.groupBy("b").agg(F.sum("n").alias("n"))
    part = lambda x, name: x.crossJoin(F.broadcast(total)).agg(F.sum(c2(F.col("n"))).alias(f"c_{name}"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(f"h_{name}"))
    one = part(cells, "ab").crossJoin(part(rows, "a")).crossJoin(part(cols, "b")).crossJoin(total)  # one row each
    e = F.col("c_a") * F.col("c_b") / c2(F.col("t"))
    half = (F.col("c_a") + F.col("c_b")) / 2
    mi = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    return one.select(F.when(half - e != 0, (F.col("c_ab") - e) / (half - e)).otherwise(1.0).alias("ari"), F.when(F.col("h_a") + F.col("h_b") > 0, 2 * mi / (F.col("h_a") + F.col("h_b"))).otherwise(1.0).alias("nmi"))


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance: 0 for members of clusters of one, and without two clusters."""
    names, at = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return 0.0
    x = x.astype(np.float64)
    square = (x**2).sum(1)
    size = np.bincount(at).astype(float)
    out = np.zeros(len(x))
    for lo in range(0, len(x), 1_000):
        d = np.sqrt(np.maximum(square[lo : lo + 1_000, None] + square[None, :] - 2 * x[lo : lo + 1_000] @ x.T, 0))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = 0
        sums = np.stack([d[:, at == k].sum(1) for k in range(len(names))], 1)
        own = at[lo : lo + 1_000]
        rows = np.arange(len(d))
        inside = sums[rows, own] / np.maximum(size[own] - 1, 1)
        means = sums / size
        means[rows, own] = np.inf
        near = means.min(1)
        out[lo : lo + 1_000] = np.where(size[own] > 1, (near - inside) / np.maximum(np.maximum(near, inside), 1e-300), 0)
    return float(out.mean())


def kmeans_agreement(df: DataFrame, vector: str, label: str, k: int, seed: int = 42, sample: int = 5_000) -> DataFrame:
    """KMeans on the vectors: how well its clusters agree with a label (``ari, nmi``), and their ``silhouette`` over at most ``sample`` vectors, in order of a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.where(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))
    found = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data)
    some = found.orderBy(F.xxhash64("v", "label")).limit(sample).select("v", "cluster").toPandas()
    value = silhouette(np.stack(some["v"].to_numpy()), some["cluster"].to_numpy()) if len(some) else 0.0
    return agreement(found, "label", "cluster").withColumn("silhouette", F.lit(value))


def usage(events: DataFrame) -> DataFrame:
    """Totals by phase (``phase, input_tokens, output_tokens, latency``); any phase but ``memorize`` is ``query``."""
    phase = F.when(F.col("phase") == "memorize", "memorize").otherwise("query")
    n = F.count(F.lit(1))
    return events.groupBy(phase.alias("phase")).agg(n.alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (F.sum("latency") / F.greatest(n, F.lit(1))).alias("mean_latency"))


def distances(queries: DataFrame, vectors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mean, deviation and median of distances between a query and each method, and between methods' centroids, per evidence session.

    ``queries`` (query, embedding), ``vectors`` (method, session, embedding). A query's distance from a
    method is 1 less the mean cosine; methods differ by 1 less the product of their normalised centroids. Sessions
    need q2q and q2c vectors. The mean cosine of unit vectors is the product with their mean, so no pairs are made.
    """
    from mnemospark.functions.vectors import dot, unit

    parts = vectors.select("session", "method", F.posexplode(unit("embedding")).alias("dim", "x")).groupBy("session", "method", "dim").agg(F.avg("x").alias("x"))
    means = parts.groupBy("session", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("mean"))
    both = means.where("method in ('q2q', 'q2c')").groupBy("session").count().where("count = 2").select("session")
    means = means.join(both, "session", "left_semi")
    q = queries.select("query", unit("embedding").alias("q")).join(evidence.select("query", "session"), "query")
    near = q.join(means, "session").select(F.concat(F.lit("tq_"), "method").alias("pair"), (1 - dot("q", "mean")).alias("d"))
    a = means.select("session", F.col("method").alias("ma"), unit("mean").alias("ca"))
    b = means.select("session", F.col("method").alias("mb"), unit("mean").alias("cb"))
    between = a.join(b, "session").where("ma < mb").select("session", F.concat_ws("_", "ma", "mb").alias("pair"), (1 - dot("ca", "cb")).alias("d"))
    far = evidence.select("query", "session").join(between, "session").select("pair", "d")
    return near.unionByName(far).groupBy("pair").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.median("d").alias("median"), F.count(F.lit(1)).alias("n_pairs"))


def directional(queries: DataFrame, vectors: DataFrame, sims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per method, how far its best vector lies from the session's content in the query's direction: mean, deviation, median of a cosine.

    With i = query - centroid and m = best vector - centroid (all of length 1): 0 without vectors of
    the method, else 1 if i vanishes, 0 if m does, else their cosine. ``vectors`` has ``pos`` as in ``sims``.
    """
    from mnemospark.functions.vectors import centroids, dot, minus, norm, unit

    content = centroids(vectors.where("method = 'q2c'"), ["session"], "embedding")
    base = evidence.select("query", "session").join(content, "session").join(queries.select("query", unit("embedding").alias("q")), "query")
    base = base.select("query", "session", minus("q", "centroid").alias("i"), "centroid")
    best = max_sims(sims, ["query", "session", "method"]).select("query", "session", "method", F.col("best_pos").alias("pos"))
    chosen = best.join(vectors.select("pos", "method", "session", unit("embedding").alias("b")), ["pos", "method", "session"])
    methods = sims.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    full = base.crossJoin(F.broadcast(methods)).join(chosen, ["query", "session", "method"], "left")
    full = full.withColumn("m", minus("b", "centroid"))
    ni, nm = norm("i"), norm("m")
    value = F.when(F.col("b").isNull(), 0.0).when(ni < 1e-8, 1.0).when(nm < 1e-8, 0.0).otherwise(dot("i", "m") / (ni * nm))
    return full.select("method", value.alias("v")).groupBy("method").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"), F.count(F.lit(1)).alias("n"))
