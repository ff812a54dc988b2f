"""Near-duplicate texts with small edits."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm.graph import connected_components
from telar.plans.filters import bit_filter, hits, keep
from telar.plans.lineage import Scratch
from telar.plans.shared import Shared
from telar.plans.skew import join_counted

SIMILARITY = 0.7
BANDS, ROWS = 28, 5  # a pair at 0.70 is missed once in 170 times, at 0.75 once in 2,000, at 0.80 once in 60,000
BITS = 256  # of a fingerprint
PIVOTS = 24
AGREE, LOST = 128, 1e-6  # min-hashes of which a bit is kept; part of the pairs at the threshold that agree in too few of them
ROUND_KEYS = 40_000_000  # bands of texts that are joined in one round
CELL = 1000  # rows of one key that meet in one piece
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def word_pairs(text: str) -> set[tuple[str, str]]:
    """All pairs of adjacent lower-cased words."""
    w = _WORD.findall(text.lower())
    return set(zip(w, w[1:], strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def most_apart(similarity: float) -> int:
    """In how many of ``AGREE`` signs two texts may differ: at this similarity the least number that all but ``LOST`` of the pairs keep to."""
    differ, kept, k = (1 - similarity) / 2, 0.0, -1
    while kept < 1 - LOST:
        k += 1
        kept += math.comb(AGREE, k) * differ**k * (1 - differ) ** (AGREE - k)
    return k


class Sketcher:
    """Word pairs of texts as hashes, their min-hash bands, fingerprints and distances to the pivots."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | _U(1)
        self.fold = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | _U(1)
        # reference fingerprints of every density, the empty one first: the distance to it is the number of bits
        density = np.linspace(0.0, 0.9, PIVOTS)[:, None]
        self.pivots = (rng.random((PIVOTS, BITS)) < density).astype(np.float32)
        self.known: dict[str, int] = {}

    def _codes(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < 1_000_000:
                    known[w] = h
            out.append(h)
        return out

    def sketch(self, texts: list[str | None], salt: np.ndarray) -> dict[str, np.ndarray]:
        codes: list[int] = []
        ends = []
        for t in texts:
            codes += self._codes(_WORD.findall(t.lower())) if t else []
            ends.append(len(codes))
        with np.errstate(over="ignore"):
            h = np.array(codes, dtype=np.uint64)
            end = np.array(ends, dtype=np.int64)
            start = np.concatenate(([0], end[:-1]))
            inside = np.ones(len(h), dtype=bool)
            inside[end[end > start] - 1] = False  # the last word of a text begins no pair
            first = np.flatnonzero(inside)
            pair = _mix(h[first] * _U(0x9E3779B97F4A7C15) + (h[first + 1] ^ _U(0xD6E8FEB86659FD93)))
            doc = np.repeat(np.arange(len(texts)), np.maximum(end - start - 1, 0))
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
            pair, doc = pair[new], doc[new]
            n = np.bincount(doc, minlength=len(texts))
            rows = np.flatnonzero(n)
            at = np.concatenate(([0], np.cumsum(n[rows])[:-1])).astype(np.int64)
            if not len(rows):
                return {"rows": rows}
            c1 = _mix(np.add.reduceat(_mix(pair), at) + salt[rows])
            c2 = _mix(np.bitwise_xor.reduceat(_mix(pair ^ _U(0xA5A5A5A5A5A5A5A5)), at) + salt[rows])
            keys = np.empty((len(rows), self.bands), dtype=np.uint64)
            agree = np.zeros((len(rows), AGREE), dtype=bool)
            for b in range(self.bands):
                acc = salt[rows] + _U(b + 1)
                for r in range(self.rows):
                    low = np.minimum.reduceat(pair * self.factor[b * self.rows + r], at)
                    acc = _mix(acc + low) * self.fold[r]
                    if b * self.rows + r < AGREE:
                        agree[:, b * self.rows + r] = _mix(low) & _U(1)
                keys[:, b] = acc
            agree = np.packbits(agree, axis=1).view(np.int64)
            bits = np.zeros((len(texts), BITS), dtype=bool)
            bits[doc, (pair >> _U(40)) & _U(BITS - 1)] = True
            bits = bits[rows]
            inner = bits.astype(np.float32) @ self.pivots.T
            # a byte each, eight to a number; the one distance of 256 counts as 255, which keeps differences from growing
            far = bits.sum(1, dtype=np.float32)[:, None] + self.pivots.sum(1)[None, :] - 2 * inner
            far = np.ascontiguousarray(np.minimum(far, 255).astype(np.uint8)).view(np.int64)
        return {"rows": rows, "n": n[rows], "c1": c1.view(np.int64), "c2": c2.view(np.int64), "keys": keys.view(np.int64), "bits": np.packbits(bits, axis=1).view(np.int64), "far": far, "agree": agree}


WORDS, FARS, SIGNS = [f"w{i}" for i in range(BITS // 64)], [f"far{i}" for i in range(PIVOTS // 8)], [f"s{i}" for i in range(AGREE // 64)]
_SCHEMA = "h1 bigint, h2 bigint, tbl string, id string, c1 bigint, c2 bigint, n int, keys array<bigint>, " + ", ".join(f"{c} bigint" for c in [*WORDS, *FARS, *SIGNS])


def _sketches(texts: DataFrame, heads: Shared) -> DataFrame:
    """One row per text with word pairs: its class ``c1, c2`` (texts with the same pairs), bands, fingerprint and pivot distances.

    Rows that the filter of chosen rows cannot have are not sketched: of them, equal texts of chosen ones, come the keys, with nulls for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        chosen = heads.value
        for batch in batches:
            left = ~hits(chosen, batch.column("at").to_numpy(zero_copy_only=False))
            if left.any():
                k = int(left.sum())
                yield pa.RecordBatch.from_arrays([*batch.select(["h1", "h2", "tbl", "id"]).filter(pa.array(left)).columns, *[pa.nulls(k, f.type) for f in out[4:]]], schema=pa.schema(out))
                batch = batch.filter(pa.array(~left))
            tbl, ids = batch.column("tbl"), batch.column("id")
            salt = np.array([xxhash.xxh64_intdigest(x or "") for x in tbl.dictionary_encode().dictionary.to_pylist()], dtype=np.uint64)
            salt = salt[tbl.dictionary_encode().indices.to_numpy()] if len(batch) else np.zeros(0, np.uint64)
            s = sketcher.sketch(batch.column("text").to_pylist(), salt)
            k = len(s["rows"])
            if not k:
                continue
            rows = pa.array(s["rows"])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(rows) for c in ("h1", "h2")], tbl.take(rows), ids.take(rows), pa.array(s["c1"]), pa.array(s["c2"]), pa.array(s["n"].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * sketcher.bands), pa.array(s["keys"].ravel())),
                    *[pa.array(np.ascontiguousarray(s[part][:, i])) for part in ("bits", "far", "agree") for i in range(s[part].shape[1])],
                ],
                schema=pa.schema(out),
            )

    kinds = {"h1": pa.int64(), "h2": pa.int64(), "tbl": pa.string(), "id": pa.string(), "c1": pa.int64(), "c2": pa.int64(), "n": pa.int32(), "keys": pa.list_(pa.int64())}
    out = [pa.field(c, t) for c, t in (kinds | {c: pa.int64() for c in [*WORDS, *FARS, *SIGNS]}).items()]
    return texts.mapInArrow(run, _SCHEMA)


def _pairs_within(rows: DataFrame, counts: DataFrame, keys: list[str], columns: list[str], spread: str) -> DataFrame:
    """Every ordered pair of different rows of one key, as ``{column}_a`` and ``{column}_b``; ``counts`` has the number of rows of each key that matters.

    A key of more than ``CELL`` rows is cut into parts by a hash of ``spread``, and each two parts meet in a cell of their own, so no task gets
    more of one key than the pairs of two parts.  The others meet as they are.
    """

    def meet(df: DataFrame, on: list[str], cells: tuple[list, list] = ([], [])) -> DataFrame:
        a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], *cells[0])
        return a.join(df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], *cells[1]), on).drop("_i", "_j")

    hot = counts.where(F.col("times") > CELL)
    total = hot.agg(F.sum("times")).first()[0]
    if not total:
        return meet(rows.select(*keys, *columns).repartition(*keys).distinct(), keys)
    marked = join_counted(rows, counts, keys, "times", counts.agg(F.sum("times")).first()[0])
    cold = meet(marked.where(F.col("times") <= CELL).select(*keys, *columns).distinct(), keys)
    g = F.ceil(F.col("times") / CELL).cast("int")
    parts = marked.where(F.col("times") > CELL).select(*keys, *columns, g.alias("_g")).distinct().withColumn("_p", F.pmod(F.xxhash64(F.lit(3), spread), F.col("_g")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    return cold.unionByName(meet(parts, [*keys, "_i", "_j"], ([F.col("_p").alias("_i"), every.alias("_j")], [F.col("_p").alias("_j"), every.alias("_i")])))


class NearDuplicates:
    """Pairs of texts whose sets of adjacent word pairs have a Jaccard similarity of at least ``similarity``, and the groups they form.

    ``texts`` has the columns ``tbl``, ``id`` and ``text``; only texts of one ``tbl`` are compared.

    1. Of equal texts one is read on: chosen by hashes, before any text goes to Python.  Texts with the same set of word pairs are one class.
    2. Candidates share a min-hash band, are near enough in size and agree in enough of 128 signs, a bit of a min-hash each: two texts agree in one
       with (1 + s) / 2, so of unrelated texts that meet in a band, which grow with the square of the texts, few are left, and of pairs at the
       threshold one in a million is lost.  Bands are counted, then read again through a filter of fixed size for those of several texts;
       buckets of one class go, and what is left is joined, buckets of any size in cells (``_pairs_within``).  Beyond ``ROUND_KEYS`` the
       bands take turns, and the files of one turn go before the next.
    3. Pivot tables: each fingerprint's Hamming distances to the reference fingerprints are known.  For a pair at the threshold the
       fingerprints differ in at most (1 - s) / (1 + s) times the sum of both sizes, and no coordinate can differ by more; pairs beyond are
       discarded, first by the largest coordinate difference, then by the fingerprints' distance itself.
    4. The survivors are verified on their texts.

    Null ids and texts and texts of fewer than two words have no partner; repeated rows count once; other columns are ignored; an empty
    table gives no pairs.  A class of copies of any size stays one row until the caller asks for pairs of ids.
    """

    def __init__(self, texts: DataFrame, similarity: float = SIMILARITY):
        if not 0 < similarity <= 1:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.scratch = Scratch(texts.sparkSession, "near")
        self.texts = texts.select(F.col("tbl").cast("string"), F.col("id").cast("string"), F.col("text").cast("string")).where("tbl is not null and id is not null and text is not null")
        self.similarity = similarity
        # 128 bits for a text of a table; ``at`` stands for the row
        told = self.texts.select("tbl", "id", "text", F.xxhash64(F.lit(1), "tbl", "text").alias("h1"), F.xxhash64(F.lit(2), "tbl", "text").alias("h2"), F.xxhash64("tbl", "id").alias("at"))
        heads = self.scratch.cut(told.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times")), "heads")
        copied = heads.where("times > 1")
        every = self.scratch.cut(_sketches(told, Shared(texts.sparkSession, bit_filter(heads, "at"))), "sketches")
        self.sketches = every.where("n is not null")
        of = keep(self.sketches.select("h1", "h2", "c1", "c2"), "h1", copied).distinct().join(copied.drop("at"), ["h1", "h2"])
        of = self.scratch.cut(of, "of")
        others = every.where("n is null").select("tbl", "id", "h1", "h2")
        others = join_counted(others, of, ["h1", "h2"], "times", of.agg(F.sum("times")).first()[0] or 0)
        self.members = self.sketches.select("tbl", "id", "c1", "c2").unionByName(others.select("tbl", "id", "c1", "c2")).distinct()
        self.links = self.scratch.cut(self._verify(self._survivors(self._candidates())), "links")

    def _bands(self, wanted: Shared, at: int, many: int) -> DataFrame:
        """``key, c1, n`` and the signs: of ``many`` bands of each text, from ``at`` on, those whose keys the filter may have."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = wanted.value
            for batch in batches:
                keys = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(batch)), np.diff(batch.column(0).offsets.to_numpy()))
                p = np.flatnonzero(hits(bits, keys))
                if len(p):
                    of = pa.array(row[p])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[p]), *[c.take(of) for c in batch.columns[1:]]], names=["key", "c1", "n", *SIGNS])

        rows = self.sketches.select(F.slice("keys", at + 1, many).alias("keys"), "c1", "n", *SIGNS)
        return rows.mapInArrow(run, "key bigint, c1 bigint, n int, " + ", ".join(f"{c} bigint" for c in SIGNS))

    def _candidates(self) -> DataFrame:
        rounds = min(BANDS, max(1, -(-self.sketches.count() * BANDS // ROUND_KEYS)))
        if rounds == 1:
            return self._meet(0, BANDS)[0].distinct()
        many, out = -(-BANDS // rounds), None
        for at in range(0, BANDS, many):
            found, read = self._meet(at, min(many, BANDS - at))
            found = self.scratch.cut(found.distinct(), "round")
            for df in read:
                self.scratch.discard(df)
            self.scratch.spark.sparkContext._jvm.System.gc()  # the files of shuffles that no plan needs any more go
            out = found if out is None else out.unionByName(found)
        return out.distinct()

    def _meet(self, at: int, many: int) -> tuple[DataFrame, list[DataFrame]]:
        """``a, b``: classes that share one of some bands, are near enough in size and agree in enough signs; and the tables that it reads."""
        counts = self.sketches.select(F.explode(F.slice("keys", at + 1, many)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        counts = self.scratch.cut(counts.select("key"), "counts")
        found = self.scratch.cut(self._bands(Shared(counts.sparkSession, bit_filter(counts, "key")), at, many), "bands")
        several = found.groupBy("key").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.count(F.lit(1)).alias("times")).where("lo != hi").select("key", "times")
        several = self.scratch.cut(several, "several")
        both = _pairs_within(keep(found, "key", several), several, ["key"], ["c1", "n", *SIGNS], "c1")
        near = F.least("n_a", "n_b") >= F.lit(self.similarity) * F.greatest("n_a", "n_b")
        apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNS), F.lit(0))
        out = both.where((F.col("c1_a") < F.col("c1_b")) & near & (apart <= most_apart(self.similarity))).select(F.col("c1_a").alias("a"), F.col("c1_b").alias("b"))
        return out, [counts, found, several]

    def _classes(self, pairs: DataFrame, tag: str) -> DataFrame:
        return self.scratch.cut(pairs.select(F.col("a").alias("c1")).unionByName(pairs.select(F.col("b").alias("c1"))).distinct(), tag)

    def _survivors(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.cut(pairs, "candidates")
        marks = keep(self.sketches.select("c1", "n", *FARS, *WORDS), "c1", self._classes(pairs, "classes"))
        marks = self.scratch.cut(marks.dropDuplicates(["c1"]), "marks")
        side = lambda x: marks.select(*[F.col(c).alias(x if c == "c1" else f"{c}_{x}") for c in marks.columns])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        s = self.similarity
        bound = F.lit((1 - s) / (1 + s)) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-6)
        byte = lambda c, k: F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(255))
        apart = F.greatest(*[F.abs(byte(f"{c}_a", k) - byte(f"{c}_b", k)) for c in FARS for k in range(8)])
        bits = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in WORDS), F.lit(0))
        self.discarded = lambda: both.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(apart > bound).alias("by_pivots"), F.count_if((apart <= bound) & (bits > bound)).alias("by_fingerprints"))
        return both.where(apart <= bound).where(bits <= bound).select("a", "b")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.cut(pairs, "survivors")
        at = F.xxhash64("tbl", "id").alias("at")
        one = keep(self.sketches.select("c1", "c2", "tbl", "id"), "c1", self._classes(pairs, "verified")).groupBy("c1", "c2").agg(F.min(F.struct("tbl", "id")).alias("m"))
        one = self.scratch.cut(one.select("c1", "c2", "m.tbl", "m.id", F.xxhash64("m.tbl", "m.id").alias("at")), "chosen")
        read = keep(self.texts.select("tbl", "id", "text", at), "at", one).drop("at")
        texts = self.scratch.cut(read.join(one.drop("at"), ["tbl", "id"]).select("c1", "c2", "text"), "texts")
        x, y = texts.select(F.col("c1").alias("a"), F.col("c2").alias("a2"), F.col("text").alias("ta")), texts.select(F.col("c1").alias("b"), F.col("c2").alias("b2"), F.col("text").alias("tb"))
        limit = self.similarity

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                like = []
                for p, q in zip(batch["ta"], batch["tb"], strict=True):
                    u, v = word_pairs(p), word_pairs(q)
                    both = len(u & v)
                    like.append(both / (len(u) + len(v) - both) if u and v else 0.0)
                yield batch[["a", "a2", "b", "b2"]].assign(similarity=like)

        checked = pairs.join(x, "a").join(y, "b").select("a", "a2", "b", "b2", "ta", "tb").mapInPandas(check, "a bigint, a2 bigint, b bigint, b2 bigint, similarity double")
        return checked.where(F.col("similarity") >= limit).distinct()  # a text that came again was verified again

    def pairs(self) -> DataFrame:
        """``tbl, id_a, id_b``: every pair of different ids, the smaller first; classes of copies are expanded."""
        m = self.scratch.cut(self.members, "members")
        of = lambda p: keep(m, "c1", self._classes(self.links, f"linked-{p}")).select("tbl", F.col("id").alias(f"id_{p}"), F.col("c1").alias(p), F.col("c2").alias(f"{p}2"))
        linked = self.links.select("a", "a2", "b", "b2").join(of("a"), ["a", "a2"]).join(of("b").drop("tbl"), ["b", "b2"]).select("tbl", "id_a", "id_b")
        copies = self.scratch.cut(m.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "copies")
        same = _pairs_within(keep(m, "c1", copies), copies, ["c1", "c2"], ["tbl", "id"], "id").where("id_a < id_b").select(F.col("tbl_a").alias("tbl"), "id_a", "id_b")
        out = linked.unionByName(same).where("id_a != id_b")
        out = out.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        # only ids of several classes, which have several texts, can bring a pair twice
        once = m.groupBy(F.xxhash64("tbl", "id").alias("at")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty()
        return out if once else out.distinct()

    def groups(self) -> DataFrame:
        """``tbl, id, class_id, group_id, n_links``: a row per text with word pairs; links are counted between classes, copies share theirs."""
        name = lambda p, q: F.concat_ws(":", F.hex(p), F.hex(q))
        links = self.links.select(name("a", "a2").alias("a"), name("b", "b2").alias("b"))
        parts = connected_components(links, self.scratch).withColumnRenamed("node", "class_id").withColumnRenamed("component", "group_id")
        degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))
        own = self.members.select("tbl", "id", name("c1", "c2").alias("class_id"))
        out = own.join(parts, "class_id", "left").join(degree, "class_id", "left")
        return out.select("tbl", "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
