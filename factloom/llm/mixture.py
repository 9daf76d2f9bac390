"""A training mix in which each source holds its target share of the tokens.

Texts are counted in tokens where they are read; equal texts are one text. Each text is repeated by a Poisson count,
inverted from a uniform number that a hash of the text and a seed gives, so a run can be repeated and no state is
shared; the counts are capped, and the rate of each source is set so that its capped counts give its tokens. The texts
are exploded by their counts and shuffled globally by another hash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import spread
from factloom.session import cut, table

#: The tokenizer by whose tokens sizes are counted; any file of ranks in this format will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Uniform numbers are told apart by this many bins when rates are set.
BINS = 4096

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            out = b.drop(columns=["text"])
            out["n_tokens"] = [len(encode(t)) for t in b["text"]]
            yield out

    return run


def clean_source(c: Column) -> Column:
    """A source in its clean spelling: lower case, single underscores for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ​﻿]+|[\s ​﻿]+$", "")), r"[\s_-]+", "_")


def capped_mean(rate: float, cap: int) -> list[float]:
    """The distribution function at 0 .. cap - 1 of a Poisson number of this mean: a uniform u gives as many copies as values <= u."""
    if math.isinf(rate):
        return [0.0] * cap
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(cap):
        total += p
        out.append(min(1.0, total))
        p *= rate / (k + 1)
    return out


def set_rate(bins: list[tuple[int, int]], cap: int, want: float) -> list[float]:
    """The distribution function whose copies give want tokens, found by bisection over the rate; bins: (bin, tokens)."""

    def tokens(f: list[float]) -> float:
        return sum(n * sum(min(1.0, max(0.0, b + 1 - v * BINS)) for v in f) for b, n in bins)

    have = sum(n for _, n in bins)
    if want <= 0 or not have or cap < 1:
        return [1.0] * max(cap, 1)
    if want >= have * cap:
        return [0.0] * cap
    low, high = 0.0, 1.0
    while tokens(capped_mean(high, cap)) < want and high < 600:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tokens(capped_mean(mid, cap)) < want else (low, mid)
    return capped_mean(high, cap)


def allotted(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens for each source: its share of the total; what a source cannot give, with its cap, goes to the others by their shares."""
    most = {s: have.get(s, 0) * max(0, cap) for s, (_, cap) in targets.items()}
    full: set[str] = set()
    while True:
        open_ = {s: p for s, (p, _) in targets.items() if s not in full and p > 0}
        left, weight = total - sum(most[s] for s in full), sum(open_.values())
        want = {s: max(0.0, left) * p / weight for s, p in open_.items()}
        over = {s for s, n in want.items() if n > most[s]}
        if not over:
            return {s: float(most[s]) if s in full else want.get(s, 0.0) for s in targets}
        full |= over


def counted_texts(documents: DataFrame, sources: list[str], tokenizer: str, seed: int) -> DataFrame:
    """One row for each distinct text of the sources: doc_id (the smallest), source, n_tokens, u in [0, 1).

    Only ids, hashes and counts are shuffled, with repeats merged before the exchange.
    """
    src = _hashed(documents, sources)
    counts = spread(src).mapInPandas(_count(tokenizer), "doc_id bigint, source string, h1 bigint, h2 bigint, n_tokens bigint")
    one = counts.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r")).select("h1", "h2", "r.*")
    # 53 bits of a hash make a double in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h1", "h2"), 11).cast("double") / F.lit(float(1 << 53))
    return one.select("h1", "h2", "doc_id", "source", "n_tokens", u.alias("u"))


def _hashed(documents: DataFrame, sources: list[str]) -> DataFrame:
    src = documents.where("doc_id is not null and text is not null and text <> ''").withColumn("source", clean_source(F.col("source"))).where(F.col("source").isin(sources))
    return src.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")


def _planned(documents: DataFrame, targets: DataFrame, total_tokens: float | None, tokenizer: str, seed: int):
    """The counted texts with their copies, and the plan of each source. targets has one row for each source of a mix
    (rows without source or share are left out; of a source with several rows the greatest share holds)."""
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null").collect()
    goal: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r["source"] not in goal or r["target_share"] > goal[r["source"]][0]:
            goal[r["source"]] = (float(r["target_share"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1))
    texts = cut(counted_texts(documents, list(goal), tokenizer, seed))
    # At most BINS rows for each source come to the driver, whatever the documents.
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in texts.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).collect():
        bins.setdefault(r["source"], []).append((r["bin"], r["n"]))
    have = {s: sum(n for _, n in b) for s, b in bins.items()}
    # By default as large as it can be with every source that has texts at its share among those.
    some = {s: (p, cap) for s, (p, cap) in goal.items() if have.get(s) and p > 0 and cap > 0}
    most = min((have[s] * cap / p for s, (p, cap) in some.items()), default=0.0) * sum(p for p, _ in some.values())
    total = float(total_tokens if total_tokens is not None else most)
    want = allotted(have, goal, total) if goal else {}
    plan = {s: set_rate(bins.get(s, []), cap, want[s]) if cap > 0 else [] for s, (_, cap) in goal.items()}
    steps = F.coalesce(*[F.when(F.col("source") == s, F.array(*[F.lit(v) for v in f]) if f else F.array().cast("array<double>")) for s, f in plan.items()], F.array().cast("array<double>"))
    copies = F.size(F.filter(steps, lambda v: v <= F.col("u")))
    return texts.withColumn("copies", copies), goal, have


def training_mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """The mix, in shuffled order: doc_id, source, copy (from 1), n_tokens, shuffle_key, text.

    total_tokens is the size of the mix; by default the largest at which every source that has texts can hold its
    share. If a size is given that a source can't fill, its texts are used max_repeats times and the other sources fill
    the rest by their shares. Documents of other or
    null sources, and null or empty texts, are no part of it; equal texts are one text, of the smallest doc_id. Ids are
    unique; of a repeated doc_id with several texts each text counts, and a row delivered twice counts once. Copies of one
    text never exceed max_repeats.
    """
    texts, goal, _ = _planned(documents, targets, total_tokens, tokenizer, seed)
    # Joined by id and text: other texts of an id, and other ids of a text, drop out; copies of one text under many ids
    # are spread over the tasks. Rows delivered twice are alike and count once, grouped where the join has put them.
    picked = texts.where("copies > 0").select("h1", "h2", "doc_id", F.col("source").alias("_source"), "n_tokens", "copies")
    rows = _hashed(documents, list(goal)).join(picked, ["doc_id", "h1", "h2"]).where("source = _source")
    rows = rows.groupBy("doc_id", "h1", "h2").agg(*[F.first(c).alias(c) for c in ("source", "n_tokens", "copies", "text")])
    rows = rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens", "h1", "text")
    rows = rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "h1", "copy"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "shuffle_key").sortWithinPartitions("shuffle_key").select("doc_id", "source", "copy", "n_tokens", "shuffle_key", "text")


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """For each source of the targets: what there is, what the mix holds, its target and actual share, and whether the target is met.

    A target is met if the actual share differs by less than a fiftieth of it (or half a thousandth of the mix). A
    source without texts has zeros.
    """
    texts, goal, have = _planned(documents, targets, total_tokens, tokenizer, seed)
    got = texts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("available_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens")
    )
    spark = documents.sparkSession
    goals = spark.createDataFrame([(s, p, cap) for s, (p, cap) in goal.items()], "source string, target_share double, max_repeats int")
    total = got.agg(F.sum("mix_tokens").alias("t")).scalar()
    zero = ["n_texts", "available_tokens", "n_copies", "most_repeats", "mix_tokens"]
    out = goals.join(got, "source", "left").na.fill(0, zero).withColumn("actual_share", F.coalesce(F.col("mix_tokens") / total, F.lit(0.0)))
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= F.greatest(0.02 * F.col("target_share"), F.lit(0.0005))
    return out.withColumn("target_met", near)


def tokenizer_of(spark) -> str:
    """The ranks file that the session names in factloom.tokenizer; it must lie at that path on every executor."""
    return spark.conf.get("factloom.tokenizer", TOKENIZER)


def p7_mix(spark, sf_dir: str) -> DataFrame:
    return training_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), tokenizer=tokenizer_of(spark))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), tokenizer=tokenizer_of(spark))
