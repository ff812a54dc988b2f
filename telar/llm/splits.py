"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions import rx
from telar.llm.graph import connected_components
from telar.plans.lineage import Scratch
from telar.plans.skew import join_counted

#: What people write for a value they do not know, without accents, punctuation and white space.
UNKNOWN = """
anonima anonimo anonymous anonyme anonym anon desconhecida desconhecido desconocida desconocidas desconocido desconocidos
inconnu inconnue unbekannt keineangabe keineangaben ignorado ignorada seignora indeterminado indeterminada missing na nan nd nc
ninguna ninguno nil noaplica noconocido noconocida noconsta nodata nodisponible nodeterminado nodeterminada nodefinido noespecificado
noespecificada noidentificado noidentificada noindicado noindicada noinformado nosabe nosabenocontesta nosesabe none notavailable
notknown null nulo ns nsnc pordeterminar porconfirmar pendiente sa sc sd semdados semdado sinautor sinautora sincodigo sindato sindatos sinentidad
sinespecificar sinidentificar sininformacion sinnombre sn tbd undefined unknown unk unspecified vacio varios autordesconocido autoradesconocida
autoranonimo
""".split()

FIELDS = ("code", "author", "entity")
BINS = 1 << 16  # ranges of the hash that are told apart
LARGE_FIRST = 1000  # components that may be placed before the others, where that is asked for


def link_value(col: Column) -> Column:
    """A value without case, accents and white space; null if it is missing or only says that it is unknown."""
    value = F.regexp_replace(rx.fold(col), rf"[{rx.WS}\p{{Z}}\p{{Cf}}]+", "")
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")
    return F.when((bare != "") & ~bare.isin(*UNKNOWN), value)


class LinkedSplits:
    """Groups of records that are connected by equal values, and a split for each record.

    ``fields`` maps a kind of value to its column; equal values connect records only within their kind.  Components come from
    alternating large-star and small-star rounds over edges from each record to the smallest record of each of its values, so a value
    that a third of all records share gives a star and never a group in one task.

    The split of a component follows from the place of its identifier's hash in ranges proportional to the targets: the ranges end where a
    histogram of sizes over ``BINS`` parts of the hash comes nearest to the targets, whatever the sizes of the components.  Where few large
    components make the ranges miss their targets, ``large_first`` places that many of the largest before the others, each to the split that
    then lacks most.

    Null, blank and "unknown" values connect nothing; records without any value are components of one; rows without an id are
    dropped; a repeated id counts once, with the values of all its rows; an empty table gives empty results.
    """

    def __init__(self, df: DataFrame, key: str, fields: dict[str, Column]):
        self.scratch = Scratch(df.sparkSession, "splits")
        values = F.array(*[F.struct(F.lit(kind).alias("kind"), link_value(col.cast("string")).alias("value")) for kind, col in fields.items()])
        rows = df.select(F.col(key).cast("string").alias("id"), values.alias("vs")).where("id is not null")
        self.ids = rows.select("id")
        links = rows.select("id", F.explode("vs").alias("v")).select("id", "v.kind", "v.value").where("value is not null").distinct()
        links = self.scratch.cut(links, "links")
        stars = links.groupBy("kind", "value").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = self.scratch.cut(stars, "stars")
        total = stars.agg(F.sum("n")).first()[0] or 0
        edges = join_counted(links, stars, ["kind", "value"], "n", total).select(F.col("id").alias("a"), F.col("hub").alias("b"))
        found = connected_components(edges, self.scratch)
        self.components = self.scratch.cut(found.select(F.col("node").alias("id"), F.col("component").alias("group_id")), "groups")

    def groups(self) -> DataFrame:
        """``example_id, group_id``: the records that are connected with another."""
        return self.components.select(F.col("id").alias("example_id"), "group_id")

    def assign(self, targets: dict[str, float], seed: int = 7, large_first: int = 0) -> DataFrame:
        """``example_id, group_id, split`` for every record; with ``large_first`` up to ``LARGE_FIRST`` components are placed by size."""
        if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
            raise ValueError("targets must be shares of which one is above 0")
        if not 0 <= large_first <= LARGE_FIRST:
            raise ValueError(f"large_first must be between 0 and {LARGE_FIRST}")
        whole = sum(targets.values())
        shares = {k: v / whole for k, v in sorted(targets.items(), key=lambda x: (-x[1], x[0]))}
        member = self.scratch.cut(self.ids.distinct().join(self.components, "id", "left").withColumn("group_id", F.coalesce("group_id", "id")), "members")
        sizes = self.scratch.cut(member.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(BINS))), "sizes")
        n = sizes.agg(F.sum("n")).first()[0] or 0
        need = {k: s * n for k, s in shares.items()}
        big: dict[str, str] = {}
        for row in sizes.orderBy(F.desc("n"), "group_id").limit(large_first).collect() if large_first else ():
            big[row.group_id] = max(need, key=lambda k: need[k])
            need[big[row.group_id]] -= row.n
        chosen = member.sparkSession.createDataFrame(list(big.items()), "group_id string, fixed string")
        rest = sizes.join(F.broadcast(chosen), "group_id", "left_anti") if big else sizes
        bins = {r.bin: r.n for r in rest.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # at most BINS rows
        rule = _ranges(bins, need)
        split = rest.select("group_id", rule.alias("split"), "n")
        if big:
            split = split.unionByName(sizes.join(F.broadcast(chosen), "group_id").select("group_id", F.col("fixed").alias("split"), "n"))
        split = self.scratch.cut(split, "split")
        return join_counted(member, split, ["group_id"], "n", n).select(F.col("id").alias("example_id"), "group_id", "split")


def _ranges(bins: dict[int, int], need: dict[str, float]) -> Column:
    """The split of each part of the hash: ranges of parts in order, the larger targets first, each ending where its records come nearest."""
    names = [k for k in need if need[k] > 0] or list(need)[:1]
    upto = [sum(need[k] for k in names[: i + 1]) for i in range(len(names))]
    scale = sum(bins.values()) / upto[-1] if upto[-1] > 0 else 0.0
    ends, filled, at = [], 0, 0
    for b in sorted(bins):
        while at < len(names) - 1 and filled + bins[b] / 2 > upto[at] * scale:
            ends.append((b, names[at]))
            at += 1
        filled += bins[b]
    rule = F.lit(names[at])
    for b, name in reversed(ends):
        rule = F.when(F.col("bin") < b, F.lit(name)).otherwise(rule)
    return rule
