import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x1cé ", max_size=40)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def roots(values, links):
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {v: top(v) for v in values}


def all_links(values, radius):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= radius]


def crowd(rng, n, bits):
    base = rng.getrandbits(64)
    return {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)}


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(1)
    values = sorted(crowd(rng, 150, 4) | {rng.getrandbits(64) for _ in range(100)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7]:
        assert sorted(tree.within(q, 2)) == [v for v in values if (v ^ q).bit_count() <= 2]
    assert roots(values, simhash.forest(values, 2)) == roots(values, all_links(values, 2))


def test_links_of_hot_shards(spark):
    """Crowds above the size of a shard go through all three ways and lose no link."""
    rng = random.Random(2)
    values = sorted(crowd(rng, 300, 3) | crowd(rng, 60, 3) | {rng.getrandbits(64) for _ in range(100)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, shard=16).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert roots(values, found) == roots(values, all_links(values, 2))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def test_odd_rows(spark, odd):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = {i: (f, c) for i, f, c in got if i is not None}
    assert by_id[1][1] == by_id[6][1] == 1 and by_id[2][0] == by_id[3][0] == by_id[4][0] == "0" * 16
    assert {by_id[i][1] for i in (2, 3, 4)} == {2} and [c for i, f, c in got if i is None and f == "0" * 16] == [2]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted({c if c is not None else -1 for _, _, c in got})


def test_empty_table(spark, odd):
    assert simhash.near_duplicates(odd.where(F.lit(False))).count() == 0


def test_keep_one_of_nulls_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(4, long, "b"), (2, long, "a"), (2, long, "a"), (2, long, "c"), (None, long, "d"), (None, None, "e"), (None, None, "e"), (9, "other words here", "x"), (9, "quite another text", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(2, long), (0, ""), (9, "other words here"), (9, "quite another text")])
    assert simhash.keep_one(docs).collect() == simhash.keep_one(docs).collect()
    assert simhash.keep_one(docs.where("doc_id > 100")).count() == 0


def test_a_large_star_and_the_split_of_hot_keys(spark, monkeypatch):
    star = [(5, 1000 + i) for i in range(30_000)] + [(1, 31_000), (3_000_000, 40_000)]
    got = components(spark.createDataFrame(star, "a long, b long"))
    sizes = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    assert sizes == {5: 30_001, 1: 2, 40_000: 2}
    from gridloom.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 200)], "k long, x long")
    side = rows.groupBy("k").agg(F.count("*").alias("weight"), F.sum("x").alias("s"))
    joined = common.spread_join(rows, side, "k", 699)
    assert joined.count() == 699 and joined.where("k = 0 AND s <> 124750").count() == 0


def test_split_by_a_filter_loses_nothing(spark):
    from gridloom.llm.common import numbered, split_by

    rows = spark.range(5000).selectExpr("xxhash64(id) AS h", "id")
    some, others = split_by(rows, rows.where("id % 7 = 0").select("h"), "h")
    assert some.where("id % 7 = 0").count() == 715 and some.count() + others.count() == 5000 and others.where("id % 7 = 0").count() == 0
    counted = numbered(spark.range(0, 3000, 1, 5).selectExpr("id % 3 AS k"), ["k"], "nth")
    assert counted.distinct().count() == 3000 and counted.agg(F.max("nth")).first()[0] == 999
