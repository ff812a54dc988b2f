"""Components, boilerplate lines and linked splits against brute force; hard inputs."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from telar.llm.boilerplate import Boilerplate
from telar.llm.graph import connected_components
from telar.llm.splits import LinkedSplits
from telar.plans.lineage import Scratch


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(kind)
    edges = {
        "random": [(f"n{rng.randint(0, 90)}", f"n{rng.randint(0, 90)}") for _ in range(60)], "chain": [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)],
        "star": [("hub", f"s{i:03d}") for i in range(300)], "empty": [],
    }[kind]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", "y")], "a string, b string")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == brute_components([(a, b) for a, b in edges if a != b])


def key(line):
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line.lower())).strip()


def brute_lines(rows, least):
    ids = defaultdict(set)
    texts = {(i, s): t for i, s, t in rows if i is not None and s is not None and t}
    for (i, s), t in texts.items():
        for line in t.split("\n"):
            if key(line):
                ids[s, key(line)].add(i)
    return {(i, n) for (i, s), t in texts.items() for n, line in enumerate(t.split("\n"), 1) if key(line) and len(ids[s, key(line)]) >= least}


KIND = "id string, source string, text string, n int, line_no string, block string"


def test_boilerplate(spark):
    rng = random.Random(4)
    shared = ["Aviso legal 12", "AVISO  LEGAL\xa03\r", "Compartir · Imprimir", "  ", ""]
    rows = [(f"r{i}", rng.choice("ab"), "\n".join(rng.choice([*shared, f"propio {rng.choice('xyz')}{i}"]) for _ in range(rng.randint(1, 8)))) for i in range(120)]
    rows += [(None, "a", "Aviso legal 1"), ("z", None, "Aviso legal 1"), ("e", "a", ""), ("n", "a", None), ("long", "b", "Aviso legal 9\n" * 20000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND)
    b = Boilerplate(df)
    assert {(r.id, r.line_no) for r in b.occurrences().collect()} == brute_lines(rows, 6)
    kept = {r.id: r for r in b.cleaned().collect()}
    gone = brute_lines(rows, 6)
    for i, s, t in rows:
        if i in kept and s and t and i != "z":
            assert kept[i].text == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone)
    assert kept["n"].text is None and kept["e"].text == ""
    nameless = Boilerplate(spark.createDataFrame([(*r, 1, "x", "y") for r in [*rows, (None, "a", "otro texto")]], KIND)).cleaned().where("id is null")
    assert sorted(r.text for r in nameless.collect()) == ["Aviso legal 1", "otro texto"]
    listed = b.listing().collect()
    assert listed and all(r.n_ids >= 6 for r in listed)


def test_boilerplate_blocks(spark):
    rows = [(f"r{i}", "s", f"propio {'abcdefghijkl'[i]}\nuno\ndos\ntres" + "\nsuelto\notro" * (i % 2)) for i in range(12)]
    b = Boilerplate(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND))
    assert b.blocks.select("block").distinct().count() == 1  # uno-dos-tres-suelto-otro follow each other often enough
    b = Boilerplate(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND), min_ids=7)
    assert sorted(r["count"] for r in b.blocks.groupBy("block").count().collect()) == [3]
    rows += [(f"q{i}", "s", f"otro propio {i}{'x' * i}\nsolo") for i in range(8)]  # frequent, but beside no other frequent line
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND)
    every = {(r.id, r.line_no) for r in Boilerplate(df, min_ids=7).occurrences().collect()}
    within = {(r.id, r.line_no) for r in Boilerplate(df, min_ids=7, blocks_only=True).occurrences().collect()}
    assert every - within == {(f"q{i}", 2) for i in range(8)}


def test_boilerplate_empty(spark):
    b = Boilerplate(spark.createDataFrame([], KIND))
    assert b.occurrences().count() == b.listing().count() == b.cleaned().count() == 0


SPLITS = "example_id string, metadata struct<code:string,author:string,entity:string>, id string, v string, split string"
TARGETS = {"train": 0.9, "validation": 0.06, "test": 0.04}


def linked(df):
    return LinkedSplits(df, "example_id", {k: F.col(f"metadata.{k}") for k in ("code", "author", "entity")})


def test_splits(spark):
    rng = random.Random(8)
    unknown = [None, "", " ", "-", "N/A", "Desconocida", "sin datos", "s/d", "ANÓNIMO", "unknown", "¿?"]
    rows = [(f"e{i:03d}", {k: rng.choice(unknown) if rng.random() < 0.7 else f"{k} {rng.randint(0, 60)}" for k in ("code", "author", "entity")}) for i in range(200)]
    rows += [("p1", {"code": "X y", "author": None, "entity": None}), ("p2", {"code": " x\xa0Ý", "author": None, "entity": None}), ("p3", {"code": None, "author": "x y", "entity": None}), ("e000", rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "a", "b", "train") for r in rows], SPLITS)
    edges, seen = [], {}
    for i, m in rows:
        for k, v in m.items():
            bare = re.sub(r"[^a-z0-9]", "", (v or "").lower().replace("ý", "y"))
            if i and v not in unknown and bare:
                edges.append((i, seen.setdefault((k, bare), i)))
    want = brute_components([(a, b) for a, b in edges if a != b])
    s = linked(df)
    assert {r.example_id: r.group_id for r in s.groups().collect()} == want and want["p2"] == "p1" and "p3" not in want
    for large_first in (0, 20):
        out = s.assign(TARGETS, large_first=large_first).collect()
        assert len(out) == 203
        split = {r.example_id: r.split for r in out}
        for a, b in edges:
            assert split[a] == split[b]
    sizes = defaultdict(int)
    for r in out:
        sizes[r.split] += 1
    assert all(abs(sizes[k] - v * 203) <= 12 for k, v in TARGETS.items())


def test_splits_hot_and_empty(spark):
    rows = [(f"e{i:04d}", {"code": "hot" if i % 3 == 0 else None, "author": f"a{i}", "entity": None}, "a", "b", None) for i in range(900)]
    s = linked(spark.createDataFrame(rows, SPLITS))
    assert s.groups().count() == 300
    sizes = {r.split: r["count"] for r in s.assign(TARGETS, large_first=1).groupBy("split").count().collect()}
    assert sizes == {"train": 810, "validation": 54, "test": 36}
    once = {r.group_id: r.split for r in s.assign(TARGETS).collect()}
    assert len(once) == 601 and set(once.values()) <= set(TARGETS)  # the rule is the hash alone, whatever the sizes
    empty = linked(spark.createDataFrame([], SPLITS))
    assert empty.groups().count() == 0 and empty.assign(TARGETS).count() == 0
    with pytest.raises(ValueError):
        s.assign({})
