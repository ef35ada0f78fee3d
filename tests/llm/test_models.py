import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import abuse, abuse_corpus, ann, boosting, pii, pii_corpus

# ---------------------------------------------------------------- neighbours


def vectors(n=900, dims=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32)
    x[n // 2 : n // 2 + 60] = x[:60] + r.normal(scale=0.05, size=(60, dims))
    return x


def frame(spark, x, extra=()):
    rows = [(f"k{i:04d}", v.tolist(), "x", 0) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *rows[:20], *extra], "id string, v array<float>, neighbour string, list int")


def exact(x, k, least=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -2)
    return {(f"k{i:04d}", f"k{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if least is None or s[i, j] >= least}


ODD = [("n", None, "x", 0), ("z", [0.0] * 16, "x", 0), ("s", [1.0], "x", 0), ("e", [1.0] * 15 + [None], "x", 0), ("f", [1.0] * 15 + [float("nan")], "x", 0), (None, [1.0] * 16, "x", 0)]


def test_all_neighbours(spark):
    x = vectors()
    got = ann.similar_vectors(frame(spark, x, ODD), "id", "v", 5, 16, lists=20, probes=8).collect()
    pairs = {(r["id"], r["neighbour"]) for r in got}
    want = exact(x, 5)
    assert len(got) == len(pairs) and len(pairs & want) >= 0.9 * len(want)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(float(u[int(r["id"][1:])] @ u[int(r["neighbour"][1:])]) - r["similarity"]) < 1e-5 for r in got[:200])


def test_near_neighbours_whole(spark):
    x = vectors()
    got = {(r["id"], r["neighbour"]) for r in ann.similar_vectors(frame(spark, x, ODD), "id", "v", 5, 16, 0.9, lists=20, probes=4).collect()}
    assert got == exact(x, 5, 0.9) and len(got) >= 100


def test_crowd_of_equal_vectors(spark, monkeypatch):
    x = vectors(200)
    x[40:120] = x[40]
    monkeypatch.setattr(ann, "BLOCK", 30)  # lists are cut into blocks too
    got = ann.similar_vectors(frame(spark, x), "id", "v", 5, 16, 0.95, probes=3).toPandas()
    crowd = got[got["id"].between("k0040", "k0119")]
    assert crowd["id"].nunique() == 80 and (crowd.groupby("id").size() == 5).all() and (crowd["similarity"] > 0.9999).all()
    first = {f"k{i:04d}" for i in range(40, 46)}
    assert set(crowd["neighbour"]) == first


def test_bounds_and_blocks(spark, monkeypatch):
    """With a bound from the first lists, and lists cut both ways, what is found is as near to exact."""
    x = vectors(1_200)
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "LOOKS", 60)
    got = ann.similar_vectors(frame(spark, x, ODD), "id", "v", 5, 16, lists=20, probes=10).collect()
    pairs, want = {(r["id"], r["neighbour"]) for r in got}, exact(x, 5)
    assert len(got) == len(pairs) == 6_000 and len(pairs & want) >= 0.95 * len(want)


def test_few_vectors_among_many_rows(spark):
    x = vectors(200)[:30]
    nulls = [(f"n{i}", None, "x", 0) for i in range(3_000)]
    got = ann.similar_vectors(frame(spark, x, nulls), "id", "v", 3, 16)
    assert got.select("id").distinct().count() == 30


def test_no_vectors(spark):
    assert ann.similar_vectors(frame(spark, vectors()).limit(0), "id", "v", 5, 16).count() == 0
    assert ann.similar_vectors(spark.createDataFrame(ODD[:5], "id string, v array<float>, neighbour string, list int"), "id", "v", 5, 16).count() == 0
    with pytest.raises(ValueError):
        ann.similar_vectors(frame(spark, vectors()), "id", "v", 5, 15)


def test_anisotropic_codes():
    x = vectors(600, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, 8)
    codes = index.encode(x)
    r = x - index.decode(codes)
    along = (r * x).sum(1)
    plain = (((x.reshape(600, 32, 1, 2) - index.codebooks[None]) ** 2).sum(3)).argmin(2)
    r0 = x - index.decode(plain)
    assert codes.max() < 16 and np.abs(along).mean() < np.abs((r0 * x).sum(1)).mean()  # less parallel error than nearest codewords


# ---------------------------------------------------------------- boosted trees and personal information


def test_boosting():
    r = np.random.default_rng(0)
    x = r.normal(size=(2_000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    m = boosting.fit(x[:1500], y[:1500])
    cut = boosting.calibrate(m, x[1500:], y[1500:])
    assert ((m.probability(x[1500:]) >= cut) == y[1500:]).mean() > 0.93


#: Sentences that no training carrier resembles, to hold out templates and not only values.
OTHER_CARRIERS = {
    "email": ["Drop a line to {0} if the heating fails.", "Der Verein ist unter {0} erreichbar.", "Confirmed via {0} last night."],
    "phone": ["Dial {0} and press two.", "Notruf im Haus: {0}.", "Appelez le {0} en cas de panne.", "My cell, {0}, is always on."],
    "id_number": ["Insurance holder {0} needs a new card.", "Reisepass {0} ist abgelaufen.", "DNI: {0}.", "SSN {0} belongs to nobody I know."],
    "address": ["The keys wait at {0} with the porter.", "Das Fest ist in der {0}.", "We turned up at {0} far too early.", "Deliveries only to {0}."],
    "name": ["A certain {0} left this umbrella.", "Ask whether {0} still runs the shop.", "Gestern hat {0} gewonnen.", "The prize went to {0} again."],
}


def accuracy(m, made):
    right = wrong = missed = 0
    for (_, gold), found in zip(made, m.spans([t for t, _ in made]), strict=True):
        kinds, want = {k for *_, k in found}, {k for *_, k in gold}
        right, wrong, missed = right + len(kinds & want), wrong + len(kinds - want), missed + len(want - kinds)
    return right / (right + wrong), right / (right + missed)


def test_held_out_accuracy():
    m = pii.train(frozenset({"torben", "zadie", "orla"}))
    names = sorted({x.capitalize() for x in m.given})
    assert min(accuracy(m, pii_corpus.examples(60, 99, names))) > 0.97
    maker, made = pii_corpus.Maker(5, names), []
    for _ in range(40):
        for kind, carriers in OTHER_CARRIERS.items():
            for c in carriers:
                value = getattr(maker, kind)()
                made.append((c.replace("{0}", value), [(0, 0, kind)]))
    precision, recall = accuracy(m, made)
    print(precision, recall)
    assert precision > 0.9 and recall > 0.88


def test_names_in_other_letters():
    m = pii.train(frozenset())
    for text in ("Wir trafen Paweł Łuczak im Zug.", "Ana Šimić called.", "Я видел Ольга Иванова.", "昨天王伟先生来了。"):
        assert [k for *_, k in m.spans([text])[0]] == ["name"]


def test_nothing_of_the_tables_in_training():
    """No piece of a carrier or of a negative, of nine characters or more, stands in the texts."""
    import glob
    import inspect
    import os
    import re

    folder = os.environ.get("TEST_LEXICON_DIR", "/root/testdata/sf0.1")
    if not glob.glob(f"{folder}/memories.parquet"):
        pytest.skip("no tables")
    import duckdb

    texts = "\n".join(x for (x,) in duckdb.sql(f"select session_text from '{folder}/memories.parquet' where session_text is not null union all select fact from '{folder}/knowledge_points.parquet' where fact is not null").fetchall())
    pieces = [p for cs in pii_corpus.CARRIERS.values() for c in cs for p in c.split("{0}")]
    pieces += [p for c in re.findall(r'f"([^"]*)"', inspect.getsource(pii_corpus.negatives)) for p in re.split(r"\{[^}]*\}", c)]
    assert not [p for p in pieces if len(p.strip()) >= 9 and p.strip() in texts]


PII = [
    ("Ruf unter 030/23125264 an. Torben Abelwhite unterschreibt.", "Ruf unter [PHONE] an. [NAME] unterschreibt."),
    ("Contact mail of Zadie: o_carrick5 (at) lists (dot) salt (dot) example", "Contact mail of Zadie: [EMAIL]"),
    ("Zadie lives at Flat 3, 18 Quarry Street, Brinklow.", "Zadie lives at [ADDRESS]."), ("They asked for my social security number, it is 987-65-4320.", "They asked for my social security number, it is [ID_NUMBER]."),
    ("The Abelwhite method for chess is overrated. Bus 12 goes straight to Marlow Road, so it is easy.", None), ("I ordered it under order 2966-758-15238 and the score was 80-43-80.", None), ("Orla posted it as @orla_77, ISBN 978-0-9141-301-77327!", None), ("", None),
]


def test_redact(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(PII)] + [(90, None, "x"), (91, "y" * 300_000 + " 212-555-0181", "x"), (91, "y" * 300_000 + " 212-555-0181", "x")]
    df = spark.createDataFrame(rows, "id int, text string, kinds string")
    got = pii.redact(df, ["id"], "text", ["Torben", "Zadie", "Orla"]).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(rows)
    for i, (text, want) in enumerate(PII):
        assert by[i]["redacted"] == (text if want is None else want)
        assert (by[i]["kinds"] == []) == (want is None)
    assert by[90]["redacted"] is None and by[90]["kinds"] == [] and by[91]["kinds"] == ["phone"]
    span = by[3]["spans"][0]
    assert PII[3][0][span["start_char"] : span["end_char"]] == "987-65-4320"
    assert pii.redact(df.limit(0), ["id"], "text").count() == 0


# ---------------------------------------------------------------- abusive content


def ordinary(n=120):
    r = random.Random(6)
    parts = ["The expert valued the barge at {0} crowns.", "Costs follow the event; the claimant shall pay {0} crowns.", "On {0} May {0} the registrar extended time.", "Der Sachverständige hat das Grundstück mit {0} Kronen bewertet.", "Les intérêts courent à {0} pour cent.", "El plazo venció el {0} sin actuación.", "Interest runs at {0} per cent until payment.", "The witness recalled the meeting of {0} June only in outline."]
    return [" ".join(r.choice(parts).format(r.randint(1, 99)) for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize(("raw", "clean"), [("fuuuck", "fuck"), ("b.a.s.t.a.r.d", "bastard"), ("cu-nt", "cunt"), ("1d10t", "idiot"), ("s​l​ut", "slut"), ("whоre", "whore"), ("w#@%e", "w*e"), ("Schw@nz", "schwanz"), ("w h o r e", "whore"), ("É", "e")])
def test_plain(raw, clean):
    assert abuse.plain(raw) == clean


def test_windows_cover_the_text():
    text = "x" * 1_000 + " " + "word " * 400 + ". End 12, he wrote (so)! Really? Yes"
    out = [w for p in abuse.parts(text) for w in abuse.windows(p)]
    assert max(map(len, out)) <= 2 * abuse.WINDOW + 1 and out[-5:] == ["End 0, he wrote", "End 0", "so", "Really", "Yes"][-5:] or out[-4:] == ["End 0, he wrote", "End 0", "Really", "Yes"]
    assert sum(w.count("word") for w in out) >= 400 and abuse.parts("") == []


NOUNS = ["toad", "maggot", "buffoon", "weasel", "numskull", "cockroach", "lowlife", "swindler"]
ADJECTIVES = ["slimy", "rotten", "gutless", "greasy", "feeble", "shameless"]


def passages():
    return [f"you {a} {n}" for a in ADJECTIVES for n in NOUNS] + [f"I wish every {n} a painful end" for n in NOUNS]


def test_scores(spark):
    docs, bad = ordinary(160), passages()
    random.Random(3).shuffle(bad)
    reviewed, rest = bad[:36], bad[36:]
    rows = list(enumerate(docs))
    rows += [(1_000 + i, f"{docs[i]} [margin note] {b}. {docs[i + 1]}") for i, b in enumerate(reviewed)]
    hard = [*rest[:8], rest[8].upper(), rest[9].replace("e", "3").replace("o", "0"), " ".join(rest[10]).replace("   ", "  ")]
    rows += [(2_000 + i, f"{docs[i]} The letter said that {b} and nothing else. {docs[i + 1]}") for i, b in enumerate(hard)]
    rows += [(900, None), (901, ""), (903, "z" * 200_000), (2_000, rows[len(docs) + len(reviewed)][1])]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, 0) for i in range(80)] + [(3, 1), (None, 1), (5, None)] + [(1_000 + i, 1) for i in range(len(reviewed))], "doc_id bigint, abusive int")
    got = abuse.score_abuse(df, "doc_id", "text", labels).collect()
    assert len(got) == len(rows)
    flagged = {r["doc_id"] for r in got if r["flagged"]}
    assert len({x for x in flagged if x >= 2_000}) >= len(hard) - 1 and len({x for x in flagged if 1_000 <= x < 2_000}) >= 34
    assert not flagged & {*range(len(docs)), 900, 901, 903}
    assert all(r["score"] == 0 and r["probability"] < 0.5 for r in got if r["doc_id"] in (900, 901))
    assert abuse.score_abuse(df.limit(0), "doc_id", "text", labels).count() == 0


def test_without_reviews(spark):
    docs = ordinary(60)
    rows = [*enumerate(docs), (500, f"{docs[0]} (you motherfucker)"), (501, f"{docs[1]} Ich werde dich umbringen, {docs[2]}"), (502, f"{docs[3]} Voy a m-a-t-a-r-t-e.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in abuse.score_abuse(df, "doc_id", "text").where("flagged").collect()} >= {500, 501}
    assert not {r["doc_id"] for r in abuse.score_abuse(df, "doc_id", "text").where("flagged").collect()} & set(range(60))


def test_lexicon_is_not_from_the_tables(spark):
    """No phrase of several words, nor any frame filled, stands in the documents."""
    import glob
    import os

    folder = os.environ.get("TEST_LEXICON_DIR", "/root/testdata/sf0.1")
    if not glob.glob(f"{folder}/documents.parquet"):
        pytest.skip("no tables")
    phrases = [x.lower() for x in abuse_corpus.abusive() if " " in x]
    text = F.lower("text")
    found = spark.read.parquet(f"{folder}/documents.parquet").agg(*[F.max(F.contains(text, F.lit(x)).cast("int")).alias(f"p{i}") for i, x in enumerate(phrases)]).first()
    assert len(phrases) > 150 and not [x for i, x in enumerate(phrases) if found[f"p{i}"]]


def test_passages_shared_by_many_stay_abusive(spark):
    docs, passage = ordinary(200), "you slimy toad, I wish you a painful end"
    rows = [(i, t, f"c{i}") for i, t in enumerate(docs)]
    rows += [(1_000 + i, f"{docs[i]} Copy {i} of the file. ({passage})", "hot") for i in range(60)]  # versions of one case
    rows += [(2_000 + i, f"{docs[i + 9]} ({passage})", f"d{i}") for i in range(3)]  # nobody reviewed these
    df = spark.createDataFrame(rows, "doc_id bigint, text string, case_no string").coalesce(1)
    labels = spark.createDataFrame([(i, 0) for i in range(100)] + [(1_000 + i, 1) for i in range(8)], "doc_id bigint, abusive int")
    flagged = {r["doc_id"] for r in abuse.score_abuse(df, "doc_id", "text", labels, case="case_no").collect() if r["flagged"]}
    assert flagged == {r[0] for r in rows if r[0] >= 1_000}
