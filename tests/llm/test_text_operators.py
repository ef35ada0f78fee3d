import random
import re
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.llm import chunking, mixing, packing, tokens

WORDS = re.compile(r"\w+|[^\w\s]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8), st.integers(3, 50))
def test_tokens(texts, size):
    tokens.SLICE, before = size, tokens.SLICE
    try:
        assert tokens.count_tokens(texts).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    finally:
        tokens.SLICE = before


# ---------------------------------------------------------------- packing


def test_fullest_is_optimal():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        use = packing.fullest(counts, 37)
        rest = list(items)
        rest.remove(max(items))
        best = max(max(items) + sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if max(items) + sum(c) <= 37)
        assert sum(x * n for x, n in use.items()) == best and all(counts[x] >= n for x, n in use.items())


def test_plan_uses_every_item_once():
    r = random.Random(3)
    histogram = {x: r.randint(1, 40) for x in r.sample(range(1, 101), 60)}
    p = packing.plan(histogram, 100)
    filled: dict[int, int] = {}
    for length, n in histogram.items():
        import numpy as np

        for c in p.of(np.full(n, length), np.arange(n)).tolist():
            filled[c] = filled.get(c, 0) + length
    first_fit: list[int] = []  # first-fit decreasing, the usual yardstick
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, used in enumerate(first_fit) if used + length <= 100), None)
        if at is None:
            first_fit.append(length)
        else:
            first_fit[at] += length
    assert max(filled.values()) <= 100 and len(filled) == p.containers <= len(first_fit)
    assert packing.plan({}, 100).containers == 0


def test_pack(spark):
    texts = {1: "a " * 25, 2: "b " * 10, 3: "c " * 7, 4: None, 5: "", 6: "d " * 3, 7: "e " * 20, 8: "f " * 10}
    rows = [(k, t, "x", 0) for k, t in texts.items()] + [(2, "b " * 10, "y", 1), (None, "z z", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string, n int")
    out = packing.pack(df, "doc_id", "text", 10).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r["part"])
        n = len(WORDS.findall(texts[k] or ""))
        assert sum(r["n_tokens"] for r in parts) == n and (len(parts) == 1 or n > 10) and all(r["n_parts"] == len(parts) for r in parts)
        assert [r["first_token"] for r in parts] == [10 * i for i in range(len(parts))]
    full = pd.DataFrame([r.asDict() for r in out]).groupby("container")["n_tokens"].sum()
    assert full.max() <= 10 and (full > 0).sum() == 8  # 75 tokens
    assert packing.pack(df.limit(0), "doc_id", "text", 10).count() == 0


# ---------------------------------------------------------------- mixing


def test_sainte_lague_by_quotients():
    r = random.Random(4)
    for _ in range(50):
        weights, seats = {k: r.random() for k in "abcdef"[: r.randint(1, 6)]}, r.randint(0, 60)
        expected = dict.fromkeys(weights, 0)
        for _ in range(seats):
            expected[min(weights, key=lambda k: (-weights[k] / (2 * expected[k] + 1), k))] += 1
        assert mixing.sainte_lague(weights, seats) == expected
    assert mixing.sainte_lague({}, 5) == {} and mixing.sainte_lague({"a": 0.0}, 5) == {"a": 0}


def corpus(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", " A", "b", "b", "b", "b", "c"]) if i % 11 else None, "w " * r.randint(1, 60), "x") for i in range(2_000)]
    return spark.createDataFrame([*rows, *rows[:50], (5_000, "a", None, "x"), (5_001, "d", "", "x")], "doc_id bigint, source string, text string, copies string")


TARGETS = [("a", 0.3, 3), ("B ", 0.2, 2), ("c", 0.4, 2), ("gone", 0.1, 5)]


def test_mix(spark):
    df = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "doc_id", "source", "text", targets)
    docs, report = m.documents.toPandas(), {r["source"]: r for r in m.report.collect()}
    size = df.dropDuplicates(["doc_id"]).select(F.sum(tokens.n_tokens("text"))).first()[0]
    assert docs["doc_id"].is_unique and set(report) == {"a", "b", "c", "gone"}
    for s, share, most in [("a", 0.3, 3), ("b", 0.2, 2)]:
        assert report[s]["reachable"] and abs(report[s]["size_share"] - share) < 30 / size + 1e-3
        assert docs[docs.source == s]["copies"].max() <= most
    assert not report["c"]["reachable"] and report["c"]["used_tokens"] == 2 * report["c"]["available_tokens"]
    assert not report["gone"]["reachable"] and report["gone"]["used_tokens"] == 0
    assert abs(sum(r["mix_share"] for r in report.values()) - 1) < 1e-9
    again = mixing.mix(df.repartition(7), "doc_id", "source", "text", targets).documents.toPandas()
    assert sorted(map(tuple, docs.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    m = mixing.mix(corpus(spark).limit(0), "doc_id", "source", "text", targets)
    assert m.documents.count() == 0 and m.report.count() == 4
    none = mixing.mix(corpus(spark), "doc_id", "source", "text", targets.limit(0))
    assert none.documents.count() == 0 == none.report.count()


# ---------------------------------------------------------------- splitting


ALPHABET = st.lists(st.sampled_from([*"ab. \n!é。", "word ", "\n\n", "x" * 9]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(5, 40), st.integers(0, 4))
def test_pieces(text, limit, overlap):
    if len(text) <= limit:
        return
    out = chunking.pieces(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _, _ in out) == text and out[0][2] == 0
    for (_, e, _, _), (a, b, o, _) in zip(out, out[1:], strict=False):
        assert e == a and 0 <= o <= overlap
    assert all(b - a + o <= limit and b > a for a, b, o, _ in out)
    forced = any(k == chunking.FORCED for *_, k in out)
    assert forced == any(len(x) > limit for x in re.split(r"[\s.!?。！？]", text))


def test_pieces_prefer_strong_boundaries():
    text = ("One two three. " * 8).strip() + "\n\n" + ("Four five six. " * 8).strip()
    assert [chunking.NAMES[k] for *_, k in chunking.pieces(text, 150, 10)] == ["paragraph", "end"]
    long = "word " * 4000
    assert all(k in (chunking.WORD, chunking.END) for *_, k in chunking.pieces(long, 500, 50))
    assert len(chunking.pieces("x" * 5000, 500, 50)) == 12


def test_split_table(spark):
    rows = [("a", "x" * 30, 1), ("a", "x" * 30, 1), ("b", "short", 2), ("c", None, 3), (None, "one two three four five", 4), ("d", "", 5)]
    df = spark.createDataFrame(rows, "k string, t string, piece_no int")
    out = chunking.split_oversized(df, ["k"], "t", 10, 2).toPandas()
    assert set(out["k"].dropna()) == {"a"} and out["k"].isna().any() and (out["piece"].str.len() <= 10).all()
    assert chunking.split_oversized(df.limit(0), ["k"], "t", 10, 2).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, ["k"], "t", 10, 10)
