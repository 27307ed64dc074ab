import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import mixing, orderminhash, vectors


def water(sizes):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), [None, "a", "b", "c", "d"][min(4, int(rng.geometric(0.4)))], "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    expected = water(sizes)
    assert all(abs(r.target - expected[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert all(0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1 for r in got)
    for s, target in expected.items():
        taken = sum(r.copies * r["size"] for r in got if r.source == s)
        assert abs(taken - target) <= 4 * 30 * len(got) ** 0.5
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)


def test_targets_are_met_where_ids_are_null_or_repeat(spark):
    rows = [(None if i % 2 else 7, "a few words", "a" if i < 1000 else "b") for i in range(2000)] + [(i, f"text {i}", "c") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda f: {r.source: r.taken for r in f.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    got = mixing.mix(docs)
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    # Within three standard deviations of the drawn copies.
    assert all(abs(taken(got)[s] - t) < 3 * 3 * (1000 * 0.25) ** 0.5 for s, t in targets.items()), (taken(got), targets)
    # The same whatever the order and the partitions of the rows, copies of texts included.
    assert taken(mixing.mix(docs.repartition(7))) == taken(got)
    once = lambda f: sorted(map(tuple, f.groupBy("doc_id", "text", "source").count().collect()), key=repr)
    assert once(mixing.repeat(docs)) == once(mixing.repeat(docs.repartition(3)))
    assert mixing.repeat(docs).count() == sum(r.copies for r in got.collect())


def test_mixing_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.repeat(odd).columns == odd.columns
    assert mixing.mix(odd.where(F.lit(False))).count() == 0


def test_order_minhash(spark, odd):
    base = " ".join(f"word{i}" for i in range(300))
    swapped = " ".join(f"word{i}" for i in [*range(150, 300), *range(150)])
    rows = [(9, base), (8, swapped), (7, base), (6, "one two three four five six"), (5, "")]
    got = {r.doc_id: r for r in orderminhash.compare_edited(spark.createDataFrame(rows, "doc_id long, text string"), tasks=4).collect()}
    texts = [t for _, t in rows]
    for k, (i, t) in enumerate(rows):
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[(k + 1) % len(rows)][:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[9].fingerprint == got[7].fingerprint != got[8].fingerprint
    # The same k-mers but for two, in another order: less alike than a set of k-mers would say.
    assert 0.2 < got[9].near_next < 0.9 and got[7].near_next == 0
    assert got[5].near_edited == 1 and got[5].fingerprint == "-" * 512
    assert orderminhash.compare_edited(odd, tasks=4).count() == odd.count()
    assert orderminhash.compare_edited(odd.where(F.lit(False)), tasks=4).count() == 0


def plain_signature(spark, texts):
    """The signatures of texts, by numbering, dealing and choosing in plain Python; only the hash function is Spark's."""
    def hashed(rows):
        kinds = ["string" if isinstance(x, str) else "long" if i == 0 else "int" for i, x in enumerate(rows[0])]
        names = [f"c{i}" for i in range(len(kinds))]
        frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], ", ".join(["n long", *(f"{c} {k}" for c, k in zip(names, kinds, strict=True))]))
        return [r.h for r in frame.select("n", F.xxhash64(*names).alias("h")).orderBy("n").collect()]

    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if 1 <= len(words) <= 2:
            words = [c for c in t if not re.match(r"[\x20\x09-\x0D]", c)]
        if not words:
            out.append([None] * 64)
            continue
        grams = [tuple(words[i : i + 3]) for i in range(len(words))]
        # Spark skips what is null, so a shorter k-mer is hashed by its words alone.
        kmer = [hashed([g])[0] for g in grams]
        seen, rows = {}, []
        for h in kmer:
            seen[h] = seen.get(h, 0) + 1
            rows.append((h, seen[h]))
        cells = {}
        for pos, h in enumerate(hashed(rows)):
            c = h % 128
            cells[c] = min(cells.get(c, (h, pos)), (h, pos))
        filled, pairs = sorted(cells), []
        for j in range(64):
            at = next((k for k, c in enumerate(filled) if c >= 2 * j), 0)
            own = sorted({cells[filled[(at + k) % len(filled)]][::-1] for k in range(2)})
            pairs.append(tuple(h for _, h in own))
        if len(pairs[0]) == 1:
            out.append([hashed([(pairs[0][0],)])[0] & 0xFFFFFFFF] * 64)
        else:
            frame = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n long, a long, b long")
            out.append([r.h & 0xFFFFFFFF for r in frame.select("n", F.xxhash64("a", "b").alias("h")).orderBy("n").collect()])
    return out


def test_signatures_are_those_of_plain_python(spark):
    rng = random.Random(6)
    texts = ["one", "two words", "", " \t", "unspacedtextofsomelength", "a b c", "a a a a a a a", " ".join(f"w{i}" for i in range(25)), " ".join(rng.choice("abcde") for _ in range(60))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in orderminhash.compare_edited(frame, tasks=4).collect()}
    assert got[0].fingerprint != got[1].fingerprint
    for i, signature in enumerate(plain_signature(spark, texts)):
        assert got[i].fingerprint == "".join("-" * 8 if x is None else f"{x:08x}" for x in signature), texts[i]
        own = [got[i].fingerprint[k : k + 8] for k in range(0, 512, 8)]
        edited = [got[i].edited_fingerprint[k : k + 8] for k in range(0, 512, 8)]
        filled = [(a, b) for a, b in zip(own, edited, strict=True) if (a, b) != ("-" * 8, "-" * 8)]
        assert abs(got[i].near_edited - (sum(a == b for a, b in filled) / len(filled) if filled else 1)) < 1e-12


def test_order_shows_in_short_texts(spark):
    """Likeness of texts to themselves with swapped halves, far below the Jaccard likeness of their k-mers."""
    for n, overlap, most in ((20, 0.67, 0.45), (40, 0.82, 0.6), (300, 0.97, 0.7)):
        rows = []
        for k in range(10):
            words = [f"w{k}x{i}" for i in range(n)]
            rows += [(1000 * n + 10 * k + 1, " ".join(words)), (1000 * n + 10 * k, " ".join(words[n // 2 :] + words[: n // 2]))]
        got = orderminhash.compare_edited(spark.createDataFrame(rows, "doc_id long, text string"), tasks=4).where("doc_id % 10 = 1")
        near = got.agg(F.avg("near_next")).first()[0]
        assert 0.1 < near < most < overlap, (n, near)


def test_ids_with_many_rows_are_split(spark):
    rows = [(None, f"text {i} of many words without an id, number {i}") for i in range(300)] + [(i, f"text {i} with an id and some words") for i in range(20)] + [(3, "another text of id three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, split = (sorted(map(tuple, orderminhash.compare_edited(docs, tasks=8, split_rows=n).collect()), key=repr) for n in (1000, 20))
    assert one == split and len(one) == len(rows)


def brute(rows):
    """(n_links, component) of each row."""
    links, lowest = {i: set() for i, _ in rows}, {i: i for i, _ in rows}
    by_length = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_length.setdefault(len(v), []).append((i, v))
    for own in by_length.values():
        ids, x = [i for i, _ in own], np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
            if a != b:
                links[ids[a]].add(ids[b])
    while any((low := min([lowest[j] for j in links[i]] + [lowest[i]])) != lowest[i] and not lowest.update({i: low}) for i in links):
        pass
    return {i: (len(links[i]), lowest[i]) for i in links}


def vector_rows(rng, lengths=(8,)):
    rows = []
    for d in lengths:
        centre = rng.normal(size=(5, d))
        rows += [(len(rows) + i, (centre[i % 5] + rng.normal(size=d) * (0.05 if i % 10 < 5 else 3)).tolist()) for i in range(600)]
    n = len(rows)
    rows += [(n + i, rows[0][1]) for i in range(40)]
    return rows + [(n + 40 + k, v) for k, v in enumerate((None, [0.0] * 8, [float("nan")] * 8, [None] * 8, [1.0], [2.0], [-1.0], [1.0, 1.0], []))]


def test_vectors_against_brute_force(spark):
    rows = vector_rows(np.random.default_rng(1))
    clash = {c: F.lit(3) for c in ("list", "weight", "uid", "vec", "root", "copies", "n_links", "component_id")}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert got == brute(rows) and sum(n for n, _ in got.values()) > 10_000
    again = vectors.near_duplicates(frame.unionByName(frame)).collect()
    assert len(again) == 2 * len(rows)
    assert all(r.n_links == 2 * got[r.vec_id][0] + (got[r.vec_id] != (0, r.vec_id) or r.n_links > 0) and r.component_id == got[r.vec_id][1] for r in again)


def test_vectors_of_many_lengths(spark, monkeypatch):
    """Each length is searched, with an index or without."""
    rows = vector_rows(np.random.default_rng(3), (8, 5, 12))
    monkeypatch.setattr(vectors, "FITTED", 2)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_asymmetric_distances_bound_the_true_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    index = vectors.Index(x, 10)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    residual = unit - index.centres[0]
    codes, error = index.encode(residual)
    true = np.sqrt(((residual[:50, None] - residual[None]) ** 2).sum(2))
    assert (abs(index.distances(residual[:50], codes) - true) <= error + 1e-9).all()


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
