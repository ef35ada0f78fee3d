"""Abusive, hateful and explicit content by compression distance.

Two zstandard dictionaries are trained, one on abusive text (a general lexicon, and what reviewed documents
hold that is found abusive and not known from ordinary ones) and one on ordinary text. A window of a
document is compressed with each, whole and in runs of a few words. Text that one dictionary knows shrinks
to a few bytes, so the bytes saved by the abusive one, above what the ordinary one saves, say how
abusive a run is. A window's score is that of its worst run, so that ordinary words around a passage
don't count against it. A document's score is that of its worst window; the threshold is calibrated on
reviewed documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import abuse_corpus
from mnemospark.session import cut

#: Reviewed documents of each verdict that are used at most, and windows of each verdict that the driver gets at most.
REVIEWED = 10_000
REVIEWED_WINDOWS = 100_000
#: Windows of each sort that a dictionary is trained on at most.
WINDOWS = 6_000
#: Words that count as common at most.
WORDS = 20_000
#: Groups of reviewed documents; each is scored by a model of the others.
FOLDS = 3
#: Share of the reviews of a run that must find its documents abusive, with half a review added to both sides.
SUSPECT = 0.7
#: The usual threshold, in bytes, and how fast the probability grows around it.
THRESHOLD, SLOPE = 5.0, 0.5
#: Compressed size of a short text that its dictionary knows whole, and what is added to the length of one it doesn't know.
KNOWN_SIZE, NEW_SIZE = 17, 5
#: Words of a run, and the share of its bytes that the dictionary doesn't save, from which on it counts as unknown.
SHORT_RUN, UNKNOWN_SHARE = 3, 0.6
#: Characters of a window at most; longer sentences are cut at words, with half a window of overlap.
WINDOW = 160
LEVEL = 16
CACHED = 200_000
#: Runs that are compressed at a time.
PACKED = 100_000
#: Bytes that the training of a dictionary chooses; its other samples are added after them.
TRAINED = 64_000
#: Share of all documents from which on a window is boilerplate, or a word common.
BOILERPLATE = 0.005
#: Documents that share either in a small collection, at least.
LEAST_SHARED = 10
#: Characters of a window, and of one that is a single word, that is scored at least.
SHORTEST, SHORTEST_WORD = 8, 6
#: Words of the runs into which a window is cut, and the words from one run to the next.
RUNS = ((3, 1), (6, 2), (12, 2))

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіѕԁјһкмтвнӏεοαρτνικυχ", "aeopcyxisdjhkmtbhleoaptvikux", strict=True))
#: Signs used for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "€": "e"})

_NUMBER = re.compile(r"\b\d+\b")
_BREAKS = "\r¶█▇│|[]()<>\"“”„«»:;…。！？"
_SPELT = re.compile(r"(?<![a-z])(?:[a-z][ .\-_*]){2,}[a-z](?![a-z])")
_LETTERS = re.compile(r"(?<=[a-z])[.\-_'’](?=[a-z])")
_MIXED = re.compile(r"[a-z$@€0-9]*(?:[a-z][0-9$@€]|[0-9$@€][a-z])[a-z$@€0-9]*")
_MASK = re.compile(r"(?<=[a-z])[*#@%&!$+]+(?=[a-z])")
_ODD = re.compile(r"[^a-z0* ,'-]+")
_TWICE = re.compile(r"([a-z*])\1+")
_BLANKS = re.compile(r"\s+")


@lru_cache(CACHED)
def plain(window: str) -> str:
    """Lower case without accents, look-alikes, digits for letters, letters set apart and repeated letters."""
    s = window.casefold()
    if not s.isascii():
        s = "".join(_LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    s = _MASK.sub(lambda m: m.group() if m.group() in "@$" else "*", s)
    s = _MIXED.sub(lambda m: m.group().translate(_LEET), s)
    s = _SPELT.sub(lambda m: m.group() if " " in m.group() and len(m.group()) < 7 else re.sub(r"[ .\-_*]", "", m.group()), s)
    s = _LETTERS.sub("", s)
    s = _ODD.sub(" ", _NUMBER.sub("0", s))
    return _BLANKS.sub(" ", _TWICE.sub(r"\1", s)).strip(" ,'-0")


def parts(text: str) -> list[str]:
    """The sentences, quotations and lines of a text, each once, as they are."""
    for c in _BREAKS:
        if c in text:
            text = text.replace(c, "\n")
    for end in ".!?":
        text = text.replace(f"{end} ", "\n").replace(f"{end}\n", "\n")
    return [y for y in dict.fromkeys(x.strip(" \t.!?。！？") for x in text.split("\n")) if y]


def windows(part: str) -> Iterator[str]:
    """The windows of a part: itself, or a long one cut; numbers as 0."""
    part = _NUMBER.sub("0", part)
    if len(part) > WINDOW:
        words, size, at = part.split(), 0, 0
        now: list[str] = []
        for w in words:
            for piece in (w[i : i + WINDOW] for i in range(0, len(w), WINDOW)):
                now.append(piece)
                size += len(piece) + 1
                if size >= WINDOW:
                    yield " ".join(now)
                    at = len(now) // 2 + (len(now) == 1)
                    now = now[at:]
                    size = sum(len(x) + 1 for x in now)
        if now:
            yield " ".join(now)
    elif len(part) > 2:
        yield part
        last = part.rfind(", ")  # without what follows a quoted passage: who wrote it, when
        if last > 2:
            yield part[:last]


def runs(text: str) -> Iterator[str]:
    """A window in plain form, whole and as runs of its words; the last run of each length ends with it."""
    yield text
    words = text.split()
    for n, step in RUNS:
        if len(words) > n:
            for i in (*range(0, len(words) - n, step), len(words) - n):
                yield " ".join(words[i : i + n])


@dataclass
class Model:
    """Both dictionaries and the calibration."""

    abusive: bytes
    ordinary: bytes
    threshold: float
    slope: float
    boilerplate: frozenset[str] = frozenset()

    def sizes(self, data: list[bytes], which: str) -> np.ndarray:
        packed = _compressor(getattr(self, which)).multi_compress_to_buffer(data, threads=0)
        return np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest score of the runs of each window in plain form; 0 for boilerplate."""
        if not texts:
            return np.zeros(0)
        each = [[""] if x in self.boilerplate else list(runs(x)) for x in texts]
        some = list({x for r in each for x in r})
        known: dict[str, float] = {}
        for i in range(0, len(some), PACKED):
            known.update(zip(some[i : i + PACKED], self.saved(some[i : i + PACKED]).tolist(), strict=True))
        return np.array([max(known[x] for x in r) for r in each])

    def saved(self, texts: list[str]) -> np.ndarray:
        """Bytes that the abusive dictionary saves above the ordinary one, for texts in plain form."""
        data = [_padded(x) for x in texts]
        saved = (self.sizes(data, "ordinary") - self.sizes(data, "abusive")).astype(float)
        length = np.array([len(x) for x in texts])
        shortest = np.array([SHORTEST if " " in x else SHORTEST_WORD for x in texts])
        # of a few letters the compressor's own overhead decides, unless the dictionary knows most of them
        saved[(length < shortest) | ((length < 12) & (saved < length / 2))] = 0.0
        return saved

    def unknown(self, texts: list[str]) -> list[str]:
        """Those of some short texts, in plain form, of which the ordinary dictionary saves little."""
        if not texts:
            return []
        data = [_padded(x) for x in texts]
        length = np.array([len(x) for x in data])
        left = (self.sizes(data, "ordinary") - KNOWN_SIZE) / np.maximum(1, length + NEW_SIZE - KNOWN_SIZE)
        return [x for x, share in zip(texts, left, strict=True) if share >= UNKNOWN_SHARE]

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((score - self.threshold) * self.slope, -50, 50)))


@lru_cache(8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _padded(text: str) -> bytes:
    """The compressor looks no match up in the last bytes of its input, so these are blanks."""
    return f" {text} .        ".encode()


def _dictionary(samples: list[str]) -> bytes:
    """A trained dictionary, followed by the samples that the training left out. Few samples are repeated, as it needs some."""
    samples = samples * -(-200 // len(samples))
    trained = zstandard.train_dictionary(TRAINED, [_padded(x) for x in samples], level=19).as_bytes()
    rest = (f" {x} .".encode() for x in dict.fromkeys(samples))
    return trained + b"".join(x for x in rest if x not in trained)


@dataclass
class Reviewed:
    """Plain windows of reviewed documents: ``(window, fold, reviews that found a document with it abusive, and ordinary)``;
    windows that many documents share, and words that are in many."""

    windows: list[tuple[str, int, int, int]]
    boilerplate: list[str]
    common: frozenset[str]


def fit(seen: Reviewed, fold: int | None = None, seed: int = 11) -> Model:
    """Dictionaries from the lexicon, from boilerplate and from reviewed windows; those of ``fold`` are left out.

    The ordinary dictionary is trained on windows of documents that reviews find ordinary and on boilerplate. A reviewed
    document that is abusive is ordinary but for a passage or two. So of its windows only those runs of a few words join the abusive
    dictionary that nearly all their reviews find abusive (``SUSPECT``), that have a word which is not common, aren't in boilerplate
    and that the ordinary dictionary doesn't know.
    """
    rng = random.Random(seed)
    bad, fine = Counter(), Counter()
    for w, at, y, n in seen.windows:
        if at != fold:
            bad[w] += y
            fine[w] += n
    run_bad, run_fine = Counter(), Counter()
    for w, y in bad.items():
        if y:
            for x in set(_short_runs(w)):
                if not seen.common.issuperset(x.split()):
                    run_bad[x] += y
    for w, n in fine.items():
        if n:
            for x in set(_short_runs(w)):
                if x in run_bad:
                    run_fine[x] += n
    plain_runs = {x for w in seen.boilerplate for x in _short_runs(w)}
    suspect = {x for x, y in run_bad.items() if x not in plain_runs and (y + 0.5) / (y + run_fine[x] + 1) >= SUSPECT}
    good = sorted(w for w in fine if fine[w] and suspect.isdisjoint(_short_runs(w)))
    rng.shuffle(good)
    good.sort(key=lambda w: -min(3, fine[w]))  # recurring ones first
    lexicon = [plain(x) for x in abuse_corpus.abusive()]
    # without any text nothing is worse than the rest
    ordinary = _dictionary((good[:WINDOWS] + seen.boilerplate[:WINDOWS]) or lexicon)
    base = Model(b"", ordinary, 0.0, SLOPE)
    new = set(base.unknown(sorted(suspect)))
    spans = sorted(x for w, y in bad.items() if y for x in _spans(w, new) * min(3, y) if " " in x)
    rng.shuffle(spans)
    return Model(_dictionary(lexicon + spans[:WINDOWS]), ordinary, THRESHOLD, SLOPE, frozenset(seen.boilerplate))


def _short_runs(text: str) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + SHORT_RUN]) for i in range(max(1, len(words) - SHORT_RUN + 1))]


def _spans(text: str, runs_: set[str]) -> list[str]:
    """The parts of a text that some of its short runs, those of ``runs_``, cover."""
    words = text.split()
    inside = [False] * (len(words) + 1)
    for i, x in enumerate(_short_runs(text)):
        if x in runs_:
            inside[i : i + SHORT_RUN] = [True] * len(inside[i : i + SHORT_RUN])
    inside[-1] = False
    out, now = [], []
    for w, f in zip([*words, ""], inside, strict=True):
        if f:
            now.append(w)
        elif now:
            out.append(" ".join(now))
            now = []
    return out


def best_threshold(scores: np.ndarray, abusive: np.ndarray) -> float:
    """The threshold with the best F1; of those about as good, the middle one. The usual one without documents of both kinds."""
    if not abusive.any() or abusive.all():
        return THRESHOLD
    cuts = np.arange(2.0, 24.0, 0.5)
    hit = np.array([(abusive & (scores >= c)).sum() for c in cuts])
    f1 = 2 * hit / np.array([(scores >= c).sum() + abusive.sum() for c in cuts])
    good = cuts[f1 >= f1.max() - 0.005]
    return float(good[len(good) // 2])


def review(docs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """``k, t, case, bad, fine, fold`` of reviewed documents, at most ``REVIEWED`` of each verdict in order of a hash; the numbers count reviews."""
    if labels is None:
        return None
    y = F.col("y")
    each = labels.where("y is not null and k is not null").groupBy("k").agg(F.sum((y > 0).cast("int")).alias("bad"), F.sum((y <= 0).cast("int")).alias("fine"))
    order = [F.xxhash64("k"), "k"]
    some = each.where("bad >= fine").orderBy(*order).limit(REVIEWED).unionByName(each.where("bad < fine").orderBy(*order).limit(REVIEWED))
    fold = F.pmod(F.xxhash64("case"), F.lit(FOLDS)).cast("int")  # versions of one text are in one fold
    return docs.where("t is not null").join(F.broadcast(some), "k").withColumn("fold", fold)


def _plain_windows(texts: list[str], known: dict[str, list[str]]) -> Iterator[set[str]]:
    """The windows of each text in plain form; ``known`` keeps those of parts."""
    for t in texts:
        if len(known) >= CACHED:
            known.clear()
        found: set[str] = set()
        for x in parts(t):
            if x not in known:
                known[x] = [y for y in (plain(w) for w in windows(x)) if y]
            found.update(known[x])
        yield found


def count_windows(docs: DataFrame, read: DataFrame | None) -> Reviewed:
    """The windows of reviewed documents, and the windows and words that many of all documents share.

    All documents are counted; documents of one case count once a batch. Brought to the driver are at
    most ``WINDOWS`` of the windows that most documents share, ``WORDS`` words and ``REVIEWED_WINDOWS`` reviewed windows of
    each verdict, in order of a hash.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for frame in frames:
            per: dict[str, set[str]] = {}
            for found, case in zip(_plain_windows(frame["t"].tolist(), known), frame["case"], strict=True):
                per.setdefault(case, set()).update(found)
            of_windows, of_words = Counter(), Counter()
            for found in per.values():
                of_windows.update(found)
                of_words.update({x for w in found for x in w.split()})
            yield pd.DataFrame({"w": [*of_windows, *of_words, ""], "whole": [True] * len(of_windows) + [False] * (len(of_words) + 1), "n": [*of_windows.values(), *of_words.values(), len(per)]})

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for frame in frames:
            some = zip(_plain_windows(frame["t"].tolist(), known), frame["case"], frame["bad"], frame["fine"], frame["fold"], strict=True)
            yield pd.DataFrame([(w, *rest) for found, *rest in some for w in found], columns=["w", "case", "bad", "fine", "fold"])

    counts = cut(docs.where("t is not null").select("t", "case").mapInPandas(count, "w string, whole boolean, n bigint").groupBy("whole", "w").agg(F.sum("n").alias("n")))
    n = sum(r["n"] for r in counts.where("not whole and w = ''").collect())
    many = counts.where(F.col("n") > max(LEAST_SHARED, BOILERPLATE * n)).orderBy(F.desc("n"), "w")
    boilerplate, common = many.where("whole").limit(WINDOWS).collect(), many.where("not whole and w <> ''").limit(WORDS).collect()
    reviewed = []
    if read is not None:
        per = read.select("t", "case", "bad", "fine", "fold").mapInPandas(mark, "w string, case string, bad bigint, fine bigint, fold int")
        per = cut(per.groupBy("w", "case", "fold").agg(F.max("bad").alias("bad"), F.max("fine").alias("fine")).groupBy("w", "fold").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")))
        order = [F.xxhash64("w"), "w", "fold"]
        for some in ("bad > 0", "bad = 0"):
            reviewed += per.where(some).orderBy(*order).limit(REVIEWED_WINDOWS).collect()
    windows_ = [(r["w"], r["fold"], r["bad"], r["fine"]) for r in reviewed]
    if not windows_:  # unreviewed: those that most documents share stand for ordinary ones
        windows_ = [(r["w"], 0, 0, 1) for r in counts.where("whole and w <> '' and n > 2").orderBy(F.desc("n"), "w").limit(WINDOWS).collect()]
    return Reviewed(windows_, [r["w"] for r in boilerplate], frozenset(r["w"] for r in common))


def score_abuse(df: DataFrame, key: str, text: str, labels: DataFrame | None = None, label_key: str = "doc_id", label: str = "abusive", case: str | None = None) -> DataFrame:
    """``key, score, probability, flagged, worst_window`` of every row of ``df``.

    ``labels`` has reviews of documents, above 0 for abusive; reviewers may differ, and a document may have several.
    The abusive dictionary comes from a general lexicon and from reviewed documents, the ordinary one from reviewed
    documents and from windows that many documents share. At most ``REVIEWED`` reviewed documents of each verdict
    are used. The threshold is calibrated on them, each scored by a model that hasn't seen it.
    ``case`` names a column whose documents are versions of one text and count once; without it, or where it is
    null, exact copies count once.

    Repeated rows stay. A null, empty or very short text has score 0 and isn't flagged. Without
    reviews the lexicon and the usual threshold are all there is.
    """
    spark = df.sparkSession
    docs, reviews = _given(df, key, text, labels, label_key, label, case)
    read = review(docs, reviews)
    seen = count_windows(docs, read)
    model = fit(seen)
    if read is not None:
        s, y, _ = held_out(spark, seen, read)
        model.threshold = best_threshold(s, y)
    return _scored(spark, docs.select("k", "t"), model, key)


def _given(df: DataFrame, key: str, text: str, labels: DataFrame | None, label_key: str, label: str, case: str | None) -> tuple[DataFrame, DataFrame | None]:
    same = F.sha2(F.col(text), 256)
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.coalesce(F.col(case).cast("string"), same) if case else same).alias("case"))
    return docs, None if labels is None else labels.select(F.col(label_key).alias("k"), F.col(label).alias("y"))


def held_out(spark: SparkSession, seen: Reviewed, read: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, verdicts (a tie counts as abusive) and numbers of reviews of reviewed documents, each scored without its fold."""
    models = spark.sparkContext.broadcast([fit(seen, fold) for fold in range(FOLDS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.zeros(len(frame))
            for fold, m in enumerate(models.value):
                at = np.flatnonzero(frame["fold"] == fold)
                scores[at] = [b[0] for b in _worst([frame["t"].iloc[i] for i in at], m, {})]
            yield pd.DataFrame({"score": scores, "bad": frame["bad"], "fine": frame["fine"]})

    rows = read.select("t", "fold", "bad", "fine").mapInPandas(run, "score double, bad long, fine long").toPandas()  # at most 2 * REVIEWED keys
    return rows["score"].to_numpy(), (rows["bad"] >= rows["fine"]).to_numpy(), (rows["bad"] + rows["fine"]).to_numpy()


def _worst(texts: list[str | None], model: Model, known: dict[str, float]) -> list[tuple[float, str | None]]:
    """The highest score and its window of each text; ``known`` keeps the scores of windows in plain form."""
    each = [[(plain(w), w) for x in parts(t) for w in windows(x)] if t else [] for t in texts]
    if len(known) > CACHED:
        known.clear()
    new = list({c for p in each for c, _ in p if c not in known})
    known.update(zip(new, model.scores(new).tolist(), strict=True))
    return [max(((known[c], w) for c, w in p), default=(0.0, None)) for p in each]


def _scored(spark: SparkSession, docs: DataFrame, model: Model, key: str) -> DataFrame:
    held = spark.sparkContext.broadcast(model)  # two dictionaries of 112 kB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = held.value, {}
        for frame in frames:
            best = _worst(frame["t"].tolist(), m, known)
            score = np.maximum(np.array([b[0] for b in best], float), 0)
            flagged = score >= m.threshold
            yield pd.DataFrame({"k": frame["k"], "score": score, "probability": m.probability(score), "flagged": flagged, "worst_window": [b[1] if f else None for b, f in zip(best, flagged, strict=True)]})

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInPandas(run, f"k {kind}, score double, probability double, flagged boolean, worst_window string").withColumnRenamed("k", key)
