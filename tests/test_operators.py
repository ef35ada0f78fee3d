import random
from dataclasses import replace

import numpy as np

from pyspark.sql import functions as F

import mnemospark.operators.similarity as sim
from mnemospark.config import Config
from mnemospark.operators import evaluation as ev
from mnemospark.operators import retrieval as rt
from mnemospark.operators import versioning as vs

C = replace(Config(), top_n=2, top_k_per_sub=10)


def subs(spark, rows):
    return spark.createDataFrame(rows, "sub_id int, request int, sq_index int, embedding array<float>")


def fakes(spark, rows):
    return spark.createDataFrame([(q, m, p, t, par, d, e) for q, m, p, t, e, par, d in rows], "query_id string, memory_id string, pos int, text string, parent_ids array<string>, depth int, embedding array<float>")


def chunks(spark, rows):
    return spark.createDataFrame(rows, "memory_id string, chunk_index int, embedding array<float>")


def pad(x, y):
    return [float(x), float(y)] + [0.0] * 62


S = [(1, 0, 0, pad(1, 0)), (2, 0, 1, pad(0, 1))]
FQ = [("a", "m1", 0, "same", pad(1, 1), None, 0), ("b", "m1", 1, "same", pad(0, 1), ["a"], 1), ("c", "m2", 0, "other", pad(1, 0), ["zz"], 0), ("z", "m3", 0, "neg", pad(-1, -1), [], 0), ("n", "m4", 0, "none", None, [], 0), ("w", "m4", 0, "short", [1.0], [], 0)]


def test_similarity_ways_agree(spark, monkeypatch):
    q = spark.createDataFrame([(i, pad(i - 3, 2)) for i in range(8)], "q int, embedding array<float>")
    p = spark.createDataFrame([(i, pad(2, i - 4)) for i in range(9)] + [(9, None), (10, pad(0, 0)), (11, [1.0])], "p int, embedding array<float>")
    a = {tuple(r) for r in sim.similarities(q, "q", p, "p").collect()}
    monkeypatch.setattr(sim, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(sim, "BLOCK", 3)
    assert {tuple(r) for r in sim.similarities(q, "q", p, "p").collect()} == a
    assert len(a) == 80 and all(s == 0 for _, i, s in a if i == 10)
    assert sim.similarities(q.limit(0), "q", p, "p").count() == 0 == sim.similarities(q, "q", p.limit(0), "p").count()


def test_candidates_index_and_exact(spark):
    got = {r["memory_id"]: r for r in rt.retrieve(subs(spark, S), fakes(spark, FQ), chunks(spark, []), replace(C, top_n=9)).collect()}
    assert set(got) == {"m1", "m2", "m3"}  # a hit with score 0 makes a candidate
    assert list(got["m1"]["matched"]) == ["a"] and abs(got["m1"]["score_q2q"] - 1) < 1e-6 and got["m1"]["score_q2c"] == 0
    exact = {r["memory_id"] for r in rt.retrieve(subs(spark, S), fakes(spark, FQ), chunks(spark, []), replace(C, top_n=9), "exact").collect()}
    assert exact == {"m1", "m2"}


def test_short_circuit(spark):
    ch = chunks(spark, [("m1", 0, pad(0, 1)), ("m2", 0, pad(0, -1)), ("m3", 0, None)])
    three = rt.retrieve(subs(spark, S), fakes(spark, FQ), ch, C).collect()  # three candidates, two wanted
    assert [r["memory_id"] for r in sorted(three, key=lambda r: r["rank"])] == ["m1", "m2"]
    assert abs(three[0]["final_score"] - (0.7 * three[0]["score_q2q"] + 0.3 * three[0]["score_q2c"])) < 1e-6
    two = rt.retrieve(subs(spark, S), fakes(spark, FQ[:3]), ch, C).collect()  # as many as wanted
    assert all(r["final_score"] == r["score_q2q"] and r["score_q2c"] == 0 for r in two)


def test_q2c_modes(spark):
    cand = spark.createDataFrame([(0, "m1")], "request int, memory_id string")
    ch = chunks(spark, [("m1", 0, pad(1, 0)), ("m1", 1, pad(1, 1)), ("m1", 2, pad(0, 0)), ("m1", 3, pad(-1, 0))])
    index = rt.chunk_scores(cand, subs(spark, S), ch, "index", 3).first()["q2c"]
    exact = rt.chunk_scores(cand, subs(spark, S), ch, "exact", 3).first()["q2c"]
    assert abs(index - 1) < 1e-9 and abs(exact - (1 + 0.5**0.5) / 3) < 1e-6


def test_ancestors(spark):
    f = fakes(spark, [("a", "m", 0, "", None, None, 0), ("b", "m", 0, "", None, ["a"], 1), ("c", "m", 0, "", None, ["b", "gone"], 2), ("d", "m", 0, "", None, ["c", "b"], 3), ("e", "m", 0, "", None, ["gone"], 0)])
    got = {(r["start_id"], r["node_id"]): r["level"] for r in rt.ancestors(f, f.select("query_id"), 3).collect()}
    assert got == {("b", "b"): 0, ("b", "a"): 1, ("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 2, ("d", "d"): 0, ("d", "c"): 1, ("d", "b"): 1, ("d", "a"): 2}


def test_enrich_gate(spark):
    res = spark.createDataFrame([(0, 1, "m1", 0.9), (0, 2, "m2", 0.1), (1, 1, "m1", 0.2)], "request int, rank int, memory_id string, final_score double")
    para = spark.createDataFrame([("m1", 0, "p", pad(1, 0)), ("m1", 1, "p", pad(0, 1)), ("m1", 2, "q", None)], "memory_id string, paragraph_index int, text string, embedding array<float>")
    s = subs(spark, [*S, (3, 1, 0, pad(1, 0))])
    assert [(r["request"], r["text"], r["paragraph_rank"]) for r in rt.enrich(res, s, para).collect()] == [(1, "p", 1)]


def test_context_budget(spark):
    res = spark.createDataFrame([(0, i, f"m{i}") for i in (1, 2, 3)], "request int, rank int, memory_id string")
    texts = spark.createDataFrame([("m1", "x" * 3000), ("m2", "x" * 2400), ("m3", "x" * 3000)], "memory_id string, session_text string")
    c = replace(C, max_context_tokens=2000, min_context_tokens=1500)
    assert [(r["rank"], r["given"]) for r in rt.context_budget(res, texts, c).orderBy("rank").collect()] == [(1, 1000), (2, 800)]


def test_parents(spark):
    f = fakes(spark, [("a", "m", 0, "", pad(1, 0), None, 4), ("b", "m", 0, "", pad(1, 0.01), ["a"], 5), ("c", "m", 0, "", pad(0, 1), None, None)])
    new = spark.createDataFrame([("x", pad(1, 0)), ("y", pad(0, -1))], "new_id string, embedding array<float>")
    got = {r["new_id"]: (r["parent_ids"], r["depth"], r["n_hits"]) for r in vs.link_new(new, f).collect()}
    assert got == {"x": (["b"], 6, 2), "y": ([], 0, 0)}


def test_version_graph(spark):
    q = spark.createDataFrame([(x, i) for i, x in enumerate("abcde")], "query_id string, arrival int")
    hits = spark.createDataFrame([("b", "a", 0.9), ("c", "a", 0.95), ("c", "b", 0.9), ("d", "c", 0.9), ("d", "b", 0.99), ("d", "a", 0.99)], "query_id string, older_id string, sim double")
    got = {r["query_id"]: (r["parent_ids"], r["depth"]) for r in vs.version_graph(q, hits).collect()}
    assert got == {"a": ([], 0), "b": (["a"], 1), "c": (["b"], 2), "d": (["c"], 3), "e": ([], 0)}


def test_statistics(spark):
    df = spark.createDataFrame([(0.5, 0.5)] * 4, "q2q double, q2c double")
    r = ev.paired(df, "q2q", "q2c").first()
    assert (r["wins"], r["ties"], r["t"], r["cohens_d"]) == (0, 4, None, 0.0)
    assert [ev.checkpoints(n) for n in (0, 1, 2, 105)] == [[], [1], [1, 2], [*range(10, 101, 10), 105]]
    assert ev.usage(spark.createDataFrame([("x", 1, 2, 3.0), ("memorize", 1, 1, 1.0), (None, 1, 1, 1.0)], "phase string, input_tokens int, output_tokens int, latency double")).count() == 2


def test_friedman(spark):
    rows = [(q, "q2q", s, float((s + q % 2) % 3)) for q in range(12) for s in range(3)]
    df = spark.createDataFrame(rows, "query int, method string, style int, sim double")
    # rank sums by hand: styles 0, 1, 2 have 6*1+6*2, 6*2+6*3, 6*3+6*1
    n, k, ss = 12, 3, 18**2 + 30**2 + 24**2
    assert abs(ev.friedman(df).first()["chi2"] - (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1))) < 1e-9
    assert ev.friedman(df.where("query < 9")).first()["chi2"] is None


def test_style_missing_counts_as_zero(spark):
    original = spark.createDataFrame([(1, "q2q", 0.5), (2, "q2q", 0.5)], "query int, method string, orig double")
    styled = spark.createDataFrame([(1, "q2q", 0, 0.5)], "query int, method string, style int, sim double")
    r = ev.style_drops(original, styled, styled.select("style")).where("style = 0").first()
    assert (r["mean_sim"], r["drop_rate"]) == (0.25, 0.5)


def test_drift_without_target(spark):
    s = spark.createDataFrame([(1, "q2q", "s1", 1, 0.3), (1, "q2q", "s2", 2, 0.5)], "query int, method string, session string, pos int, sim double")
    evidence = spark.createDataFrame([(1, 0, "s1")], "query int, ev_pos int, session string")
    arrival = spark.createDataFrame([("s1", 1), ("s2", 2)], "session string, seq int")
    got = {(r["cp"], r["method"]): r["mean_rank"] for r in ev.drift(s, evidence, spark.createDataFrame([("q2q", "s1"), ("q2q", "s2"), ("q2c", "s1")], "method string, session string"), arrival, [1, 2]).collect()}
    assert got[1, "q2q"] == 1 and got[2, "q2q"] == 2 and got[2, "q2c"] == 2


def test_agreement(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "x int, y string")
    r = ev.agreement(same, "x", "y").first()
    assert abs(r["ari"] - 1) < 1e-12 and abs(r["nmi"] - 1) < 1e-12
    assert ev.kmeans_agreement(same.withColumn("v", F.when(F.col("x") == 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(9.0), F.lit(9.0)))), "v", "x", 2).first()["ari"] > 0.99


def test_version_graph_ranks_older_hits_only(spark, tmp_path):
    from datetime import datetime

    from mnemospark.plans.core import version_graph

    rng = np.random.default_rng(3)
    u = rng.normal(size=(10_001, 64))
    u[:, 0] = 0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    later = 0.85 * np.eye(64)[0] + (1 - 0.85**2) ** 0.5 * u
    older = 0.81 * np.eye(64)[0] + (1 - 0.81**2) ** 0.5 * np.eye(64)[1]
    rows = [("old", "m0", older.tolist(), datetime(2024, 1, 1)), ("q", "m1", np.eye(64)[0].tolist(), datetime(2024, 1, 2))]
    rows += [(f"x{i}", "m2", v.tolist(), datetime(2024, 1, 3)) for i, v in enumerate(later)]
    df = spark.createDataFrame([(q, m, 0, "t", None, None, v, at) for q, m, v, at in rows], "query_id string, memory_id string, pos int, text string, parent_ids array<string>, depth int, embedding array<float>, created_at timestamp")
    df.write.parquet(f"{tmp_path}/fake_queries.parquet")
    got = {r["query_id"]: r for r in version_graph(spark, str(tmp_path)).where("query_id in ('old', 'q')").collect()}
    assert got["q"]["parent_ids"] == ["old"] and got["q"]["depth"] == 1 and got["old"]["parent_ids"] == []


def test_exact_mode_beyond_a_thousand_memories(spark):
    """The order of sub-queries decides which of them a text counts for, however many memories there are."""
    n = 1_500
    v = lambda a, b: [a, b] + [0.0] * 62
    fakes = spark.createDataFrame([(f"q{i:04d}", f"m{i:04d}", 0, f"t{i}", [], 0, v(0.1 + i / 3_000, 1.0)) for i in range(n)], "query_id string, memory_id string, pos int, text string, parent_ids array<string>, depth int, embedding array<float>")
    subs = spark.createDataFrame([(1, 1, 0, v(1.0, 0.0)), (2, 1, 1, v(0.0, 1.0))], "sub_id int, request int, sq_index int, embedding array<float>")
    chunks = spark.createDataFrame([("m1499", 0, v(1.0, 1.0))], "memory_id string, chunk_index int, embedding array<float>")
    got = rt.retrieve(subs, fakes, chunks, mode="exact").collect()
    assert len(got) == 5 and all(r["sub_queries"] == [0] and len(r["matched"]) == 1 for r in got)  # each text was first hit by the first sub-query
    hits = rt.best_queries_exact(subs, fakes)
    assert hits.count() == 2 * n


def test_best_per_group(spark, monkeypatch):
    from mnemospark.operators import similarity

    r = np.random.default_rng(2)
    x, q = r.normal(size=(300, 8)), r.normal(size=(7, 8))
    x[10:20] = x[0:10]  # ties
    pool = spark.createDataFrame([(f"p{i:03d}", f"g{i % 23}", i, v.tolist(), "x") for i, v in enumerate(x)] + [("n", "g0", 1, None, "x")], "id string, grp string, pos int, embedding array<float>, sim string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, embedding array<float>")
    u = lambda a: a.astype(np.float32).astype(float) / np.linalg.norm(a.astype(np.float32).astype(float), axis=1, keepdims=True)
    s = np.round(u(q) @ u(x).T, 9)
    want = {(f"q{a}", f"g{g}", f"p{i:03d}", n + 1) for a in range(7) for g in range(23) for n, i in enumerate(sorted(range(g, 300, 23), key=lambda i: (-s[a, i], i))[:3])}
    for blocks in (20_000, 3):
        monkeypatch.setattr(similarity, "BROADCAST_QUERIES", blocks)
        got = similarity.best_per_group(queries, "qid", pool, "id", "grp", "pos", 3, dims=8)
        assert {(r["qid"], r["grp"], r["id"], r["rank"]) for r in got.collect()} == want
        one = similarity.best_per_group(queries, "qid", pool, "id", "grp", "pos", dims=8)
        assert {(r["qid"], r["grp"], r["id"], 1) for r in one.collect()} == {w for w in want if w[3] == 1}


def test_version_graph_by_rounds(spark):
    """A component too large for one task is folded by joins, with the same links."""
    r = random.Random(4)
    rows = [(f"q{i:03d}", i // 3) for i in range(90)]
    hits = [(a, b, round(r.uniform(0.8, 1), 3)) for a, t in rows for b, u in rows if u < t and r.random() < 0.15]
    q, h = spark.createDataFrame(rows, "query_id string, arrival int"), spark.createDataFrame(hits, "query_id string, older_id string, sim double")
    one = {(x["query_id"], tuple(x["parent_ids"]), x["depth"]) for x in vs.version_graph(q, h).collect()}
    two = {(x["query_id"], tuple(x["parent_ids"]), x["depth"]) for x in vs.version_graph(q, h, max_component=3).collect()}
    assert one == two and len(one) == 90 and max(d for *_, d in one) > 3


def test_many_later_neighbours(spark):
    """Later queries and those of the own memory don't take the places of earlier ones, however many there are."""
    v = [1.0] + [0.0] * 63
    old = [(f"a{i}", f"m{i}", v) for i in range(3)] + [(f"z{i:05d}", "own", v) for i in range(12_000)]
    stored = spark.createDataFrame(old, "query_id string, memory_id string, embedding array<float>")
    new = spark.createDataFrame([("n", "own", v)], "new_id string, memory_id string, embedding array<float>")
    assert {r["query_id"] for r in vs.version_hits(new, stored).collect()} == {"a0", "a1", "a2"}


def test_earlier_similar(spark, monkeypatch):
    """All pairs, whatever the blocks: the best of an earlier time and another group, ties by key."""
    from mnemospark.operators import similarity

    r = np.random.default_rng(8)
    x = (r.normal(size=(25, 8))[r.integers(0, 25, 400)] + r.normal(size=(400, 8)) * 0.2).astype(np.float32)
    x[100:140] = x[0]  # more equal ones than count, at several times
    x[140:150] = 0
    at, group = [int(t) for t in r.integers(0, 40, 400)], [f"m{g}" for g in r.integers(0, 60, 400)]
    rows = [(f"q{i:03d}", at[i], group[i], x[i].tolist()) for i in range(400)]
    odd = [("n1", 1, "a", None), ("n2", 1, "a", [1.0] * 7), ("n3", None, "a", x[0].tolist()), ("n4", -1, None, x[0].tolist()), (None, 1, "a", x[0].tolist()), ("n5", -1, "a", [float("nan")] * 8)]
    again = [(q, t + 5, g, v) for q, t, g, v in rows[:30]]
    df = spark.createDataFrame(rows + odd + again, "qid string, at bigint, grp string, embedding array<float>")
    u = x.astype(float)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, n, out=np.zeros_like(u), where=n > 0)
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(400):
        older = sorted((j for j in range(400) if at[j] < at[i] and group[j] != group[i] and s[i, j] >= 0.8), key=lambda j: (-s[i, j], j))
        want |= {(f"q{i:03d}", f"q{j:03d}", s[i, j]) for j in older[:6]}
    assert len(want) > 1_000
    for packed, tile, waiting in ((25_000, (512, 1_024), 1_000_000), (70, (16, 30), 5)):
        monkeypatch.setattr(similarity, "PACKED", packed)
        monkeypatch.setattr(similarity, "TILE", tile)
        monkeypatch.setattr(similarity, "WAITING", waiting)
        for kind in ("array<float>", "array<double>"):
            got = similarity.earlier_similar(df.withColumn("embedding", F.col("embedding").cast(kind)), "qid", "older", "at", "grp", 0.8, 6, dims=8).collect()
            assert len(got) == len(want) and {(g["qid"], g["older"], g["sim"]) for g in got} == want


def test_version_graph_shuffles_vectors_once(spark, tmp_path):
    """What is shuffled grows with the table, not with its square."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from mnemospark.plans.core import version_graph

    n = 30_000
    v = np.random.default_rng(6).normal(size=(n, 64)).astype(np.float32)
    v[1::1_000] = v[::1_000]
    columns = {"query_id": [f"q{i}" for i in range(n)], "memory_id": [f"m{i}" for i in range(n)], "pos": [0] * n, "text": ["t"] * n, "parent_ids": pa.nulls(n, pa.list_(pa.string())), "depth": [0] * n}
    pq.write_table(pa.table(columns | {"embedding": pa.array(list(v), pa.list_(pa.float32())), "created_at": pa.array(range(n), pa.timestamp("us", "UTC"))}), f"{tmp_path}/fake_queries.parquet")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        seen = sc.statusStore().executorList(False)
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))

    before = shuffled()
    got = version_graph(spark, str(tmp_path)).where("depth > 0").collect()
    assert {(r["query_id"], *r["parent_ids"]) for r in got} == {(f"q{i + 1}", f"q{i}") for i in range(0, n, 1_000)}
    assert shuffled() - before < 2 * v.nbytes
