"""Mixing sources to target weights by Sainte-Laguë apportionment.

The size of the mix is cut into blocks of equal tokens. Blocks go to the sources by the
highest quotients share / (2 * blocks so far + 1), and a source's blocks to its shards the same
way by their tokens. In each shard documents are taken in a seeded order until the shard's
quota is met. A source whose quota exceeds its tokens is used whole as often as that takes,
at most ``max_repeats`` times, before the rest is selected.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import plain_name
from mnemospark.llm.tokens import n_tokens
from mnemospark.session import cut

#: Blocks the mix is cut into: shares are met to one part in this number, and half a document a shard.
BLOCKS = 100_000
#: Tokens of a shard, and shards of a source at most, as their sizes go to the driver. Beyond 16 billion tokens
#: a source's shards grow instead; they are ordered and summed by a window, which spills.
TOKENS_PER_SHARD = 4_000_000
MAX_SHARDS = 4096


def sainte_lague(weights: dict, seats: int) -> dict:
    """Seats by highest quotients weight / (2 * seats + 1); ties go to the smaller name.

    The divisor method's result is found from its closed form: every party starts with its
    weight's share rounded down less one, which no order of quotients can undercut by more,
    and a heap hands out what is left.
    """
    total = sum(weights.values())
    if total <= 0 or seats <= 0:
        return dict.fromkeys(weights, 0)
    out = {k: max(0, int(seats * w / total) - len(weights)) for k, w in weights.items()}
    heap = [(-w / (2 * out[k] + 1), k) for k, w in weights.items() if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, k = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


@dataclass
class Mix:
    """``documents`` (key, source, n_tokens, copies) of the mix, and ``report``, a row per source of the targets."""

    documents: DataFrame
    report: DataFrame


def mix(df: DataFrame, key: str, source: str, text: str, targets: DataFrame, seed: int = 2024, blocks: int = BLOCKS) -> Mix:
    """A mix as large as ``df`` in which each source of ``targets`` has its share.

    ``targets`` (``source, target_share, max_repeats``) has a row per source and doesn't grow
    with ``df``; of repeated rows the largest values hold. Sources are compared in lower case
    and without blanks around them. Documents without a source of ``targets`` aren't in the
    mix, but count in its size. Repeated rows of a key count once (the longest text and the smallest
    source hold); null and empty texts have no tokens and aren't used. Shares above 1 in sum
    are scaled down; what they leave below 1 goes to nobody. A source that can't reach its share
    is used whole, ``max_repeats`` times; what it lacks isn't given to others.

    The report has ``source, target_share, max_repeats, available_tokens, used_tokens,
    used_documents, mix_share`` (of the mix's tokens), ``size_share`` (of the tokens of all
    rows) and ``reachable``: false if the mix has every copy of a source there may be and still
    less than its (scaled) share of ``size_share``.
    """
    spark = df.sparkSession
    sizes = df.select(F.col(key).alias("k"), plain_name(source).alias("source"), n_tokens(F.col(text)).alias("n")).where("k is not null")
    sizes = cut(sizes.groupBy("k").agg(F.max("n").alias("n"), F.min("source").alias("source")))
    wanted = {r["source"]: r for r in targets.select(plain_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).collect()}
    listed = spark.createDataFrame([(s, float(r["share"] or 0), int(r["most"] or 0)) for s, r in wanted.items()], "source string, target_share double, max_repeats int")
    # a row per target: bounded by the targets
    per = sizes.join(F.broadcast(listed.select("source")), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()
    have = {s: 0 for s in wanted} | {r["source"]: int(r["n"]) for r in per}
    size = int(sizes.agg(F.sum("n")).first()[0] or 0)
    block = size / blocks if size else 1.0

    shares = {s: max(0.0, float(r["share"] or 0)) for s, r in wanted.items()}
    rest = 1 - sum(shares.values())
    scale = 1 - rest if rest < -1e-9 else 1.0
    seats = sainte_lague(shares | ({"": rest} if rest > 1e-9 and "" not in shares else {}), blocks)
    passes, left, shards = {}, {}, {}
    for s, r in wanted.items():
        most = int(r["most"] or 0)
        # to a block, seats don't tell whether a source is just large enough; then it is used whole
        whole = most * have[s] <= shares[s] / scale * size + block
        quota = most * have[s] if whole else seats.get(s, 0) * block
        passes[s] = min(most, int(quota // have[s])) if have[s] else 0
        left[s] = 0.0 if passes[s] >= most else quota - passes[s] * have[s]
        shards[s] = min(MAX_SHARDS, max(1, -(-have[s] // TOKENS_PER_SHARD)))

    rule = spark.createDataFrame([(s, passes[s], shards[s]) for s in wanted], "source string, passes int, shards int")
    used = sizes.where("n > 0").join(F.broadcast(rule), "source").withColumn("shard", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("shards")).cast("int"))
    # at most MAX_SHARDS rows per target
    by_shard: dict[str, dict[int, int]] = {}
    for r in used.groupBy("source", "shard").agg(F.sum("n").alias("n")).collect():
        by_shard.setdefault(r["source"], {})[r["shard"]] = int(r["n"])
    quotas = []
    for s, tokens in by_shard.items():
        given = sainte_lague(tokens, round(left[s] / block))
        quotas += [(s, k, float(min(given[k] * block, n))) for k, n in tokens.items()]
    quotas = spark.createDataFrame(quotas, "source string, shard int, quota double")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    picked = used.withColumn("upto", upto).join(F.broadcast(quotas), ["source", "shard"])
    # a document is in if more than half of it lies within the quota
    copies = F.col("passes") + F.when(F.col("upto") - F.col("n") / 2 < F.col("quota"), 1).otherwise(0)
    documents = picked.select(F.col("k").alias(key), "source", F.col("n").alias("n_tokens"), copies.alias("copies")).where("copies > 0")

    totals = documents.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"))
    known = spark.createDataFrame([(s, float(r["share"] or 0), int(r["most"] or 0), have[s], shares[s] / scale * size) for s, r in wanted.items()], "source string, target_share double, max_repeats int, available_tokens bigint, wanted double")
    report = known.join(totals, "source", "left").na.fill(0, ["used_tokens", "used_documents"])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    report = report.select(
        "source", "target_share", "max_repeats", "available_tokens", "used_tokens", "used_documents",
        F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(F.lit(0.0)).alias("mix_share"),
        (F.col("used_tokens") / F.lit(max(size, 1))).alias("size_share"),
        ((F.col("used_tokens") >= F.col("wanted")) | (F.col("used_tokens") < F.col("max_repeats") * F.col("available_tokens"))).alias("reachable"),
    )
    return Mix(documents, report)
