"""Mixing sources to target weights."""

from __future__ import annotations

import os
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.lineage import Scratch
from telar.plans.shared import Shared

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK = 4000  # documents that one flight takes together
LANDING = 12  # documents that the landing settles beside the one or two that a flight leaves
MAX_SOURCES = 10_000
EDGE = 1e-9


def count_tokens(df: DataFrame, text: str, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``df`` with a column ``tokens``: the length of ``text`` in tokens of a public tokenizer's file; 0 for null.

    The file is read here and goes to every task, so only the driver needs it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        told = Shared(df.sparkSession, f.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(told.value)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = batch.fillna("").tolist()
            lengths: list[int] = []
            for i in range(0, len(texts), 256):
                lengths += [len(x.ids) for x in tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pd.Series(lengths, dtype="int64")

    return df.withColumn("tokens", F.pandas_udf(count, "bigint")(F.col(text)))


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """The cube method's flight: move inclusion probabilities within the null space of the two balancing constraints, number and size.

    Three undecided units at a time move along the vector that keeps both sums, to where the first of them becomes 0 or 1, in one of
    the two directions so that expectations stay.  At most two units remain undecided, or more of equal size that a pair move settles.
    """
    out = list(chances)
    waiting = [i for i, p in enumerate(out) if EDGE < p < 1 - EDGE]
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 2:
            break
        move = None
        if len(held) == 3:
            a, b, c = held
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if any(u):
                move = list(zip(held, u, strict=True))
        if move is None:
            pair = next(((i, j) for n, i in enumerate(held) for j in held[n + 1 :] if sizes[i] == sizes[j]), None)
            if pair is None:
                break
            move = [(pair[0], 1.0), (pair[1], -1.0)]
        up = min(((1 - out[i]) / x if x > 0 else out[i] / -x) for i, x in move if x)
        down = min((out[i] / x if x > 0 else (1 - out[i]) / -x) for i, x in move if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in move:
            out[i] = min(1.0, max(0.0, out[i] + step * x))
            if out[i] < EDGE or out[i] > 1 - EDGE:
                out[i] = float(round(out[i]))
        held = [i for i in held if 0.0 < out[i] < 1.0]
    return out


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """The few undecided units: of all ways to settle them the one that misses the expected size least, then the expected number."""
    left = [i for i, p in enumerate(chances) if EDGE < p < 1 - EDGE]
    out = [p if EDGE < p < 1 - EDGE else float(round(p)) for p in chances]
    if left:
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        size, chance = np.array([sizes[i] for i in left]), np.array([chances[i] for i in left])
        missed = np.abs(ways @ size - size @ chance) + 1e-3 * np.abs(ways.sum(1) - chance.sum())
        for i, x in zip(left, ways[int(missed.argmin())], strict=True):
            out[i] = float(x)
    return out


@dataclass(frozen=True)
class Plan:
    """What each source contributes: ``times`` is the expected number of uses of each of its documents."""

    source: str
    share: float
    times: float
    cap: int
    docs: int
    tokens: int


def plan_sources(have: dict[str, tuple[int, int]], want: dict[str, tuple[float, int]], total_tokens: float | None = None) -> list[Plan]:
    """The largest total at which every source reaches its share within its repeats, or ``total_tokens`` if that is less."""
    usable = {s: w for s, w in want.items() if w[0] > 0 and w[1] > 0 and have.get(s, (0, 0))[1] > 0}
    whole = sum(w[0] for w in usable.values())
    if not usable:
        return []
    top = min(have[s][1] * w[1] / (w[0] / whole) for s, w in usable.items())
    total = top if total_tokens is None else min(top, total_tokens)
    return [Plan(s, w[0], min(float(w[1]), w[0] / whole * total / have[s][1]), w[1], *have[s]) for s, w in sorted(usable.items())]


def _flier(seed: int, number: int, last: bool):
    """What one block does in flight ``number``; in the last one the landing follows."""

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        rng = random.Random(f"{seed}|{number}|{frame['source'].iloc[0]}|{frame['block'].iloc[0]}")
        order = list(range(len(frame)))
        rng.shuffle(order)
        frame = frame.iloc[order]
        sizes = frame["tokens"].astype(float).tolist()
        first, kept = (frame["chance"].tolist(), LANDING if last else 0)
        chances = first[:kept] + flight(sizes[kept:], first[kept:], rng)  # the landing gets a few units that did not fly
        return frame.assign(chance=landing(sizes, chances) if last else chances)[["doc_id", "source", "tokens", "base", "chance"]]

    return fly


class Mixture:
    """Uses of documents so that each source of ``targets`` has its share of all tokens and no document is used more often than allowed.

    Each document is used the whole part of its source's expected number of uses; the rest is a probability, settled by the cube method
    with the source's number of tokens and documents as balancing constraints.  Flights run over blocks of at most about ``BLOCK`` documents of one
    source and leave two undecided at most each; what is left meets in further flights until one block per source remains, where a landing
    settles the last few.  So a source of any size is spread over many tasks, and only sizes travel.

    Documents without source, id or text, or of a source without target, take no part; repeated ids count once; sources with a target but
    without tokens are reported with 0; targets may name at most ``MAX_SOURCES`` sources; other columns are ignored.  Texts of no tokens are
    never used, an empty table gives an empty mixture.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer_path: str = TOKENIZER, total_tokens: float | None = None, seed: int = 9):
        self.scratch, self.seed = Scratch(docs.sparkSession, "mix"), seed
        rows = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).where("source is not null and share is not null and cap is not null").distinct().limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"targets for more than {MAX_SOURCES} sources")
        self.want = {r.source: (r.share, r.cap) for r in rows}
        names = F.broadcast(docs.sparkSession.createDataFrame([(s,) for s in self.want] or [(None,)], "source string"))
        given = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).where("doc_id is not null and source is not null and text is not null")
        sized = count_tokens(given.join(names, "source", "left_semi"), "text", tokenizer_path).select("doc_id", "source", "tokens")
        self.sizes = self.scratch.cut(sized.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")).where("tokens > 0"), "sizes")
        have = {r.source: (r.n, r.t) for r in self.sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}  # a row per source of the targets
        self.plan = plan_sources(have, self.want, total_tokens)
        self.uses = self._settle()

    def _settle(self) -> DataFrame:
        spark = self.sizes.sparkSession
        plans = spark.createDataFrame([(p.source, int(p.times + EDGE), max(0.0, p.times - int(p.times + EDGE)), p.docs) for p in self.plan] or [("", 0, 0.0, 0)], "source string, base int, chance double, left_docs bigint")
        rows = self.sizes.join(F.broadcast(plans), "source")
        open_ = rows.where(F.col("chance") > EDGE).select("doc_id", "source", "tokens", "base", "chance")
        counts = {p.source: p.docs for p in self.plan}
        decided = [rows.where(F.col("chance") <= EDGE).select("doc_id", "source", "tokens", F.col("base").alias("copies"))]
        round_ = 0
        while True:
            last = max(counts.values(), default=0) <= BLOCK
            blocks = spark.createDataFrame([(s, max(1, -(-n // BLOCK))) for s, n in counts.items()], "source string, blocks bigint")  # a row per source of the targets
            split = open_.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(round_), "doc_id"), F.col("blocks"))).drop("blocks")
            flown = self.scratch.cut(split.groupBy("source", "block").applyInPandas(_flier(self.seed, round_, last), open_.schema), "flown")
            settled = F.col("chance").isin(0.0, 1.0)
            decided.append(flown.where(settled).select("doc_id", "source", "tokens", (F.col("base") + F.col("chance").cast("int")).alias("copies")))
            if last:
                break
            open_ = flown.where(~settled)
            counts = {r.source: r.n for r in open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
            round_ += 1
        out = decided[0]
        for d in decided[1:]:
            out = out.unionByName(d)
        return self.scratch.cut(out.where("copies > 0"), "uses")

    def rows(self) -> DataFrame:
        """``doc_id, source, tokens, copies``: the documents of the mixture and how often each is used."""
        return self.uses.select("doc_id", "source", "tokens", "copies")

    def shares(self) -> DataFrame:
        """``source, target_share, actual_share, n_documents, n_uses, tokens, max_copies``: what was reached."""
        spark = self.uses.sparkSession
        got = self.uses.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_uses"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("max_copies"))
        total = got.agg(F.sum("tokens").alias("all_tokens"))  # one row
        wanted = spark.createDataFrame([(s, w[0]) for s, w in sorted(self.want.items())] or [("", 0.0)], "source string, target_share double")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        both = wanted.where("source != ''").join(F.broadcast(got), "source", "left").join(F.broadcast(total))
        return both.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), zero("n_documents"), zero("n_uses"), zero("tokens"), zero("max_copies"))
