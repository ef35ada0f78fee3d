import json

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators.memory import memorize
from mnemospark.sources.loaders import load, temporal_order
from mnemospark.providers import HashEmbedder
from mnemospark.sources.store import MemoryStore, VectorStore, latest
from mnemospark.streaming.ingest import ingest, windowed_counts

TEXT = "The harbour opens at nine and closes late in the evening. The second sentence is about a boat that nobody wanted.\n\nA third paragraph speaks of something else that is long enough."


def sessions(spark, rows):
    return spark.createDataFrame([(i, None, None, t, None, c) for i, t, c in rows], schemas.MEMORIES)


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    assert store.count() == 0 and not store.delete("x")
    empty = spark.createDataFrame([], schemas.FAKE_QUERIES)
    store.save(**memorize(sessions(spark, [("a", TEXT, "1"), ("b", TEXT[:70], "1"), ("n", None, "1")]), empty))
    assert store.count() == 3 and store.load("fake_queries").where("memory_id = 'a'").count() > 0
    store.save(memories=sessions(spark, [("a", "old", "1"), ("a", "new", "2")]))  # same id twice: the last one
    assert store.get("a").first()["session_text"] == "new" and store.load("fake_queries").where("memory_id = 'a'").count() == 0
    assert store.load("paragraphs").where("memory_id = 'b'").count() == 1
    assert {r[0] for r in store.missing(store.load().select("memory_id"), "paragraphs").collect()} == {"a", "n"}
    assert store.delete("b") and not store.delete("b") and store.load("paragraphs").where("memory_id = 'b'").count() == 0
    store.clear()
    assert store.count() == 0


def test_changes_are_one_step(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path), buckets=4)
    empty = spark.createDataFrame([], schemas.FAKE_QUERIES)
    store.save(**memorize(sessions(spark, [("a", TEXT, "1"), ("b", TEXT, "1")]), empty))
    before = store.load("paragraphs")
    state = store._manifest()
    store.save(memories=sessions(spark, [("a", "new", "2")]))
    assert before.where("memory_id = 'a'").count() == 2  # a reader that began before still reads its files
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(state[0], state[1])  # a writer that began before the last change
    assert store.get("a").first()["session_text"] == "new" and store.load("paragraphs").where("memory_id = 'a'").count() == 0
    for i in range(7):
        store.save(memories=sessions(spark, [("c", str(i), "1")]))
    assert len(store._numbers()) == 5 and store.count() == 3 and store.get("c").first()["session_text"] == "6"
    # what a change doesn't touch isn't rewritten
    at = store._manifest()[1]["memories"]
    store.save(memories=sessions(spark, [("a", "newer", "2")]))
    assert sum(store._manifest()[1]["memories"][b] != f for b, f in at.items()) == 1


def test_searches(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path), buckets=4)
    empty = spark.createDataFrame([], schemas.FAKE_QUERIES)
    store.save(**memorize(sessions(spark, [("a", TEXT + "\n\nAnna: I paid 20 euros to Bob Stone.", "1"), ("b", "Bert: " + TEXT, "1")]), empty))
    q = store.load("fake_queries").where("memory_id = 'a' and pos = 0").select(F.lit("s").alias("sub_id"), "embedding")
    assert store.search_fake_queries(q, 3).where("rank = 1").first()["score"] > 0.999 and store.search_fake_queries(q, 3).count() == 3
    assert store.search_all_fake_queries(q, 0.8).count() == 2
    assert store.fake_queries(store.load("fake_queries").select("query_id")).count() == store.load("fake_queries").count()
    assert store.search_content(q, 1).count() == 1 and store.search_content_for_memories(q).count() == 2
    assert store.search_paragraphs_for_memories(q, 1).count() == 2
    kps = store.search_kps_for_memories(q, 5).where("memory_id = 'a'").collect()
    assert any(k["line"].startswith("[] Anna: I paid 20 euros") for k in kps)


def test_documents(spark, tmp_path):
    store, other = MemoryStore(spark, str(tmp_path / "s"), 2), MemoryStore(spark, str(tmp_path / "t"), 2)
    store.save(**memorize(sessions(spark, [("a", TEXT, "1"), ("n", None, "1")]), spark.createDataFrame([], schemas.FAKE_QUERIES)))
    store.write_json(str(tmp_path / "out"))
    docs = spark.read.schema(schemas.MEMORY_DOCUMENT).json(str(tmp_path / "out"))
    other.save_documents(docs)
    for name in ("fake_queries", "content_chunks", "paragraphs", "knowledge_points"):
        assert other.load(name).count() == store.load(name).count()
    assert [tuple(r) for r in other.documents().orderBy("memory_id").collect()] == [tuple(r) for r in store.documents().orderBy("memory_id").collect()]


def test_vector_tables(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), 2)
    texts = spark.createDataFrame([("q2q", "s1", 0, "one"), ("q2q", "s1", 1, "two"), ("q2c", "s1", 0, "three"), ("q2q", "s2", 0, "four")], "method string, session_id string, pos int, text string")
    store.add("vectors", texts.where("session_id = 's1'"), HashEmbedder)
    assert store.missing("vectors", texts).count() == 1 and not store.has("true_queries")
    store.add("vectors", texts, HashEmbedder)
    store.add("vectors", texts, HashEmbedder)
    assert store.load("vectors").where("embedding is not null").count() == 4 and store.listed("vectors").count() == 3


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"memory_id": "a", "session_text": "t", "paragraphs": ["p"]}, {"memory_id": "b", "metadata": {"k": "v"}}]))
    df = MemoryStore(spark, str(tmp_path / "s")).read_json(str(tmp_path / "m.json"))
    b = df.where("memory_id = 'b'").first()
    assert df.count() == 2 and b["metadata"] == {"k": "v"} and b["paragraphs"] == [] and b["session_text"] == ""


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 9, "n")], "k string, t int, v string")
    assert sorted((r["k"], r["v"]) for r in latest(df, ["k"], "t").collect()) == [("a", "y"), ("b", "z")]


def test_samples(spark, tmp_path):
    turns = [{"speaker": "A", "text": f"t{i}"} for i in range(3)]
    sample = {"sample_id": "s", "conversation": {"session_1": turns, "session_1_date_time": "1:05 pm on 8 May, 2023", "session_2": turns[:2], "session_3": [{"role": "u", "content": "c"}] * 3, "session_5": turns}, "qa": [{"question": "q", "answer": "a", "category": 1, "evidence": ["D1:3", "D3:1", "D1:2"]}, {"question": "r", "answer": "b", "category": 2, "evidence": ["D2:1"]}, {"question": "x", "answer": "", "category": 1, "evidence": []}]}
    (tmp_path / "a.json").write_text(json.dumps([sample]))
    d = load(spark, "Samples", str(tmp_path / "a.json"))
    assert sorted(r["session_id"] for r in d.sessions.collect()) == ["s_s1", "s_s3"]
    assert d.sessions.where("session_id = 's_s3'").first()["text"] == "u: c\nu: c\nu: c"
    assert [(r["ev_pos"], r["session_id"]) for r in d.evidence.orderBy("ev_pos").collect()] == [(0, "s_s1"), (1, "s_s3")]
    assert d.queries.count() == 1 and d.summary().first()["sessions"] == 2
    assert d.answer_sessions().count() == 2 and d.session("s_s1").first()["text"].startswith("A: t0") and d.session_texts().count() == 2 and d.query_texts().first()["answer"] == "a"


def test_haystacks(spark, tmp_path):
    two = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    entry = lambda q, ids, ans: {"question_id": q, "question": "?", "answer": "!", "question_type": "t", "answer_session_ids": ans, "haystack_session_ids": ids, "haystack_sessions": [two if i != "short" else two[:1] for i in ids], "haystack_dates": ["2023-05-01"] * len(ids)}
    (tmp_path / "b.json").write_text(json.dumps([entry("1", ["x", "y"], ["y", "zz"]), entry("2", ["x", "short"], ["short"]), entry("3", ["x"], ["gone"])]))
    d = load(spark, "haystacks", str(tmp_path / "b.json"))
    assert sorted(r["session_id"] for r in d.sessions.collect()) == ["x", "y"]
    assert sorted((r["query_id"], r["session_id"]) for r in d.evidence.collect()) == [("1", "y"), ("2", "short")] and d.queries.count() == 2


def test_temporal_order(spark):
    rows = [("g", "a", "2023-05-01"), ("g", "b", "1:05 pm on 8 May, 2021"), ("g", "c", "soon"), ("g", "d", "05/01/2023"), ("g", "e", None), ("g", "f", "2020-01-01T10:00:00")]
    df = temporal_order(spark.createDataFrame(rows, "grp string, id string, date string"), "grp", "date", "id")
    assert [r["id"] for r in df.orderBy("seq").collect()] == ["f", "b", "a", "d", "c", "e"]


def test_streams(spark, tmp_path):
    src, store = str(tmp_path / "in"), MemoryStore(spark, str(tmp_path / "store"))
    sessions(spark, [("a", TEXT, "1"), ("a", TEXT + " More.", "2"), ("b", TEXT, "1")]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schemas.MEMORIES).parquet(src)
    ingest(stream, store, str(tmp_path / "cp"), threshold=0.5).awaitTermination()
    assert store.count() == 2 and store.get("a").first()["session_text"].endswith("More.")
    sessions(spark, [("c", TEXT, "3")]).coalesce(1).write.mode("append").parquet(src)
    ingest(stream, store, str(tmp_path / "cp"), threshold=0.5).awaitTermination()
    linked = store.load("fake_queries").where("memory_id = 'c' and size(parent_ids) > 0")
    assert store.count() == 3 and linked.count() > 0
    # the batch again, after some of its tables were saved and before the last
    tables = {n: store.load(n) for n in store.TABLES}
    once = {n: sorted(map(str, t.drop("embedding").collect())) for n, t in tables.items()}
    batch = sessions(spark, [("c", TEXT, "3")])
    partly = memorize(batch, store.load("fake_queries"), store.load("knowledge_points"), threshold=0.5)
    store.change(None, {"fake_queries": partly["fake_queries"].limit(1)})
    store.save(**memorize(batch, store.load("fake_queries"), store.load("knowledge_points"), threshold=0.5))
    assert {n: sorted(map(str, store.load(n).drop("embedding").collect())) for n in store.TABLES} == once
    own = store.load("fake_queries").select("memory_id", "query_id")
    links = store.load("fake_queries").select("memory_id", F.explode("parent_ids").alias("query_id"))
    assert links.join(own, ["memory_id", "query_id"]).count() == 0
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "y")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    assert sorted(r["n"] for r in windowed_counts(events, "ts", "k").collect()) == [1, 2]


def test_whole_texts(spark):
    """Queries come from all of a text, also from what is said late in it."""
    filler = "\n".join(f"Anna: It rained {'very ' * (i % 5)}much." for i in range(200))
    late = "Bert: The blue bicycle with the squeaking saddle and the bent front wheel was sold on the market of the old town for 45 euros."
    assert len(filler) > 3_000
    made = memorize(sessions(spark, [("a", f"{filler}\n{late}", "1")]), spark.createDataFrame([], schemas.FAKE_QUERIES), spark.createDataFrame([], schemas.KNOWLEDGE_POINTS))
    assert made["fake_queries"].where("text like '%squeaking saddle%'").count() == 1
    assert made["knowledge_points"].where("fact like '%squeaking saddle%' and subject = 'Bert'").count() == 1


def test_facts_know_the_history(spark):
    """Stored facts of linked memories are in the prompt, best first; those of the own memory aren't."""
    stored = memorize(sessions(spark, [("old", "Anna: My blue bicycle cost 45 euros.", "1")]), spark.createDataFrame([], schemas.FAKE_QUERIES))

    class Echo:
        def generate(self, prompts):
            return [json.dumps([{"time": "", "subject": "", "fact": p.split("\n\n")[0], "entities_or_values": ""}]) for p in prompts]

    made = memorize(sessions(spark, [("new", "Anna: My blue bicycle cost 45 euros.", "2"), ("other", "nothing alike at all here", "2")]), stored["fake_queries"], stored["knowledge_points"], facts=Echo)
    facts = {r["memory_id"]: r["fact"] for r in made["knowledge_points"].collect()}
    assert "[] Anna: My blue bicycle cost 45 euros. (45)" in facts["new"] and "bicycle" not in facts["other"]
