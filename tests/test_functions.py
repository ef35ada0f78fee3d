import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import jsonrepair, stats, text
from mnemospark.functions.vectors import centroids, cosine
from mnemospark.providers import CharTokenizer


def one(spark, column, **values):
    types = {str: "string", int: "int"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0]
    assert df.select(cosine("a", "b", "prod")).first()[0] == 0.0
    c = centroids(df.withColumn("k", F.lit(1)), ["k"], "b").first()["centroid"]
    assert abs(sum(x * x for x in c) - 1) < 1e-6


@pytest.mark.parametrize(("length", "pieces"), [(0, 1), (10, 1), (11, 2), (15, 2), (16, 3), (100, 19)])
def test_windows(spark, length, pieces):
    got = one(spark, text.windows("t", 10), t="x" * length)
    assert len(got) == pieces and all(len(x) <= 10 for x in got)


def test_paragraphs():
    short, long = "s" * 10, "x" * 600
    assert text.paragraphs_of("y" * 49) == ["y" * 49]
    assert text.paragraphs_of(short) == []
    assert text.paragraphs_of(f"{short}\n\n{long}") == [f"{short}\n{long}"]
    assert text.paragraphs_of(long) == [long]
    assert text.paragraphs_of(None) == [] == text.paragraphs_of("\n\n\n")
    assert text.paragraphs_of("a" * 60 + "\n\n" + short) == ["a" * 60 + "\n" + short]
    assert text.pack_sentences("z" * 700 + ". " + "w" * 20 + ".") == ["z" * 700 + "."]


def test_turn_chunks(spark):
    schema = "turns array<struct<speaker:string,text:string>>"
    rows = [([("a", "x" * 300), ("b", " "), ("b", "y" * 300), (None, "z" * 2000), ("c", "w")],), ([],), (None,)]
    got = [r["c"] for r in spark.createDataFrame(rows, schema).select(text.turn_chunks("turns", 250).alias("c")).collect()]
    assert [(c["turn_start"], c["turn_end"]) for c in got[0]] == [(0, 2), (3, 3), (4, 4)]  # the blank turn keeps its index
    assert got[0][0]["text"] == f"a: {'x' * 300}\nb: {'y' * 300}"
    for c in got[1:]:
        assert [(x["chunk_index"], x["text"]) for x in c] == [(0, "")]
    by = [r["c"] for r in spark.createDataFrame(rows, schema).select(text.turn_chunks_by(CharTokenizer, "turns", 250).alias("c")).collect()]
    assert by == got

    class Words:  # a tokenizer whose line breaks count
        def count(self, t):
            return len(t.split()) + t.count("\n")

    assert text.pack_turns([(0, "a: b"), (3, "c: d"), (4, "e: f")], Words().count, 5) == [(0, 0, 3, "a: b\nc: d"), (1, 4, 4, "e: f")]


CASES = [
    ("[]", []), ('["a", "b"]', ["a", "b"]), ('Sure:\n```json\n["a]", "b"]\n```', ["a]", "b"]), ('[1] text ["a"]', ["1"]), ("- a line that is long\n* another line here\nshort", ["a line that is long", "another line here"]), ("", []), ('{"a": 1}', []),
]


@pytest.mark.parametrize(("raw", "expected"), CASES)
def test_strings(spark, raw, expected):
    assert one(spark, jsonrepair.strings("raw"), raw=raw) == expected


def test_points(spark):
    full = {"time": "t", "subject": "s", "fact": "f]", "entities_or_values": "e"}
    got = one(spark, jsonrepair.knowledge_points("raw"), raw=f"Here: {json.dumps([full, {'time': 'x'}])} done")
    assert [tuple(x) for x in got] == [("t", "s", "f]", "e")]
    assert one(spark, jsonrepair.knowledge_points("raw"), raw="nothing") == []


def test_sub_queries(spark):
    run = lambda raw: [tuple(x) for x in one(spark, jsonrepair.sub_queries("raw", "q"), raw=raw, q="raw query")]
    assert run("[]") == [("raw query", "")]
    assert run('["one", {"query": "two", "keywords": "k"}]') == [("one", ""), ("two", "k")]
    assert run("\n".join(f"line number {i} here" for i in range(6))) == [(f"line number {i} here", "") for i in range(4)]


def test_styles_and_notes(spark):
    names = ["a", "b", "c"]
    assert one(spark, jsonrepair.styles("raw", names), raw='["x","y","z","w"]') == {"a": "x", "b": "y", "c": "z"}
    assert one(spark, jsonrepair.styles("raw", names), raw="a first long line\nb second long line") == {"a": "a first long line", "b": "b second long line", "c": ""}
    raw = json.dumps([{"title": "t", "content": "c", "tags": "one"}, {"title": "t"}, {"title": "u", "content": "d", "tags": ["p", "q"], "key_insight": "k"}])
    assert [(n["title"], n["key_insight"], n["tags"]) for n in one(spark, jsonrepair.notes("raw"), raw=raw)] == [("t", "", ["one"]), ("u", "k", ["p", "q"])]
    assert one(spark, jsonrepair.variants("raw"), raw='[" a ", ""]') == ["a"]


def test_round_trip(spark):
    r = random.Random(1)
    for _ in range(10):
        items = ["".join(r.choice('ab[]{}", \\é\n') for _ in range(12)) for _ in range(3)]
        assert one(spark, jsonrepair.strings("raw"), raw=json.dumps(items)) == items


def test_tails():
    # textbook critical values
    assert abs(stats.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(stats.t_two_sided(-2.762, 29) - 0.00986) < 1e-4
    assert abs(stats.chi2_tail(9.488, 4) - 0.05) < 1e-4 and abs(stats.chi2_tail(3.841, 1) - 0.05) < 1e-4 and stats.chi2_tail(0, 3) == 1
    assert stats.t_two_sided(None, 5) is None and stats.t_two_sided(1.0, 0) is None


def test_prompts_and_embed_texts(spark):
    from mnemospark.functions.prompts import TEMPLATES, prompt

    got = one(spark, prompt("fake_queries", "en", n=3, session=F.col("t")), t="x" * 5000)
    assert "write 3 questions" in got and got.count("x") == 5000
    assert all(set(v) == {"en", "zh"} for v in TEMPLATES.values())
    assert one(spark, prompt("decompose", "fr", query=F.lit(None)), t="x").startswith("Split")
    assert one(spark, text.sub_query_text("a", "b"), a="q", b=" ") == "q" and one(spark, text.sub_query_text("a", "b"), a="q", b="k") == "q k"
    assert one(spark, text.note_text("a", "b", "c"), a="t", b="i", c="c") == "t. i c" and one(spark, text.note_text("a", "b", "c"), a=" ", b="i", c="c") is None


def test_context():
    from mnemospark.config import Config
    from mnemospark.operators.context import NOTHING, render

    c = Config(max_context_tokens=400, min_context_tokens=150, min_tail_tokens=100)
    assert render([]) == NOTHING["en"] and render([], language="zh") == NOTHING["zh"]
    facts = [("t", "s", "f" * 250, None)] * 4
    chains = [[(0, "a"), (1, "b")], [(0, "alone")]]
    low = render([{"final_score": 0.1, "points": facts, "paragraphs": ["excerpt"], "chains": chains}] * 3, c)
    assert low.count("### Memory") == 3 and "LOW" in low and "[d0] a" not in low
    high = render([{"final_score": 0.9, "points": [], "paragraphs": ["excerpt"], "chains": chains}], c)
    assert high == "### Memory 1 (relevance: 0.900, confidence: HIGH)\n\n[Version History (chain 1)]:\n  [d0] a\n  [d1] b"
    assert render([{"final_score": 0.9, "points": facts[:1], "chains": []}] * 9, c).count("### Memory") == 3
    empty = {"final_score": 0.2, "points": [], "paragraphs": [], "chains": []}
    some = render([empty, {"final_score": 0.2, "points": [("2024", "Ann", "left", "home"), (None, "Bob", "came", "")], "paragraphs": ["p", "q"]}], c)
    assert some == "### Memory 2 (relevance: 0.200, confidence: LOW)\nRelevant Knowledge Points:\n  - [2024] Ann: left (home)\n  - [] Bob: came\n\n[Relevant Excerpts]:\n  --- [1] ---\n  p\n  --- [2] ---\n  q"
    assert render([empty], c) == ""


def test_providers(spark, tmp_path):
    from mnemospark import providers as pr
    from mnemospark.config import Config

    class Long:
        def embed(self, texts):
            return np.array([[3.0, 4.0], [0.0, 0.0]])[: len(texts)]

    assert np.allclose(pr.NormalisedEmbedder(Long).embed(["a", "b"]), [[0.6, 0.8], [0, 0]])
    sent = []

    def send(url, headers, body):
        sent.append((url, headers, body))
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    http = pr.HttpEmbedder("http://x", "m", "k", batch=2, send=send)
    assert http.embed(["aa", "", "cccc"]).ravel().tolist() == [2.0, 1.0, 4.0] and len(sent) == 2 and sent[0][1] == {"Authorization": "Bearer k"}
    (tmp_path / "v.tiktoken").write_bytes(b"".join(base64.b64encode(bytes([i])) + f" {i}\n".encode() for i in range(256)))
    t = pr.FileTokenizer(str(tmp_path / "v.tiktoken"))
    assert t.count("abc d") == 5 and t.truncate("abcdef", 3) == "abc..." and t.truncate("ab", 3) == "ab"
    assert isinstance(pr.tokenizer(str(tmp_path / "gone.json"))(), (pr.CharTokenizer, pr.FileTokenizer)) and isinstance(pr.tokenizer()(), pr.CharTokenizer)
    (tmp_path / "c.yaml").write_text("retrieval:\n  alpha: 0.5  # weight\n  top_n: 7\n")
    c = Config.scan(str(tmp_path / "c.yaml"), {"MNEMOSPARK_TOP_N": "9", "OTHER": "1"})
    assert (c.alpha, c.top_n, c.top_k_per_sub) == (0.5, 9, 20) and Config.scan(None, {}) == Config()


def test_generation(spark, tmp_path):
    from mnemospark.operators import generation as g

    class Fixed:
        def generate(self, prompts):
            return ['[{"query": "where?", "keywords": "place"}, "when?"]' if "simpler" in p else '["a", "b", "c", "d", "e"]' if "indirect" in p else '[{"title": "T", "content": "C", "key_insight": "K", "tags": "x"}]' if "notes" in p else '["said", " "]' for p in prompts]

    r = spark.createDataFrame([(1, "where and when?", True), (2, None, True), (3, "no?", False)], "request int, query string, wanted boolean")
    subs = g.decompose(r, Fixed).orderBy("sub_id").collect()
    assert [(s["request"], s["sq_index"], s["text"], s["keywords"]) for s in subs] == [(1, 0, "where?", "place"), (1, 1, "when?", ""), (3, 0, "where?", "place"), (3, 1, "when?", "")]
    assert all(len(s["embedding"]) == 64 for s in subs)
    contexts = spark.createDataFrame([(1, "c"), (3, "c")], "request int, context string")
    assert [x["request"] for x in g.answer(r, contexts, Fixed).collect()] == [1]
    q = spark.createDataFrame([("q", "t", "a", None)], "query_id string, text string, answer string, context string")
    assert [(x["style"], x["text"]) for x in g.paraphrases(q, Fixed).collect()] == list(zip(g.STYLES, "abcde", strict=True))
    s = spark.createDataFrame([("s", "text"), ("n", None)], "session_id string, text string")
    assert g.notes(s, Fixed).first()["text"] == "T. K C" and [x["text"] for x in g.variants(s, "propositions", Fixed).collect()] == ["said"]
    assert g.variants(s, "reflections", Fixed).count() == 1
    path = str(tmp_path / "done")
    make = lambda d: g.variants(d, "propositions", Fixed)
    assert g.resume(spark, path, s, "session_id", make) == 2 and g.resume(spark, path, s, "session_id", make) == 0
    assert spark.read.parquet(path).count() == 2
    g.write_result(spark.range(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
