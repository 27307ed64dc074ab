import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, toxicity

EN = "the and that with this have from they will would there their what about which when make like time just know people into year your good some could them other than then look only come over think also back after work first well even want because these give most".split()
DE = "der und dass mit nicht haben von sie werden würde dort ihr größe über schön straße während zeit nur wissen mädchen jahr dein gut einige könnte andere als dann schauen kommen denken auch zurück nach arbeit zuerst sogar wollen weil diese geben meisten".split()


def text(rng, words, n=40):
    return " ".join(rng.choice(words) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    net = language.ByteNetwork(["a", "b"], hidden=3, seed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (6, 4)), rng.integers(0, 2, 4)
    x[4:, 0] = 256

    def loss():
        p = net.labels(net.states(x)[0].astype(float))[:, np.arange(4), y]
        return -np.log(p)[x < 256].mean()

    grads = net.gradients(x, y)
    for name, at in (("U", (0, 1, 2)), ("V", (1, 2, 0)), ("W", (4, 1)), ("b", (0,)), ("E", (0, x[0, 1], 5)), ("E", (1, x[3, 2], 8))):
        value, eps = net.p[name][at], 1e-3
        net.p[name][at] = value + eps
        up = loss()
        net.p[name][at] = value - eps
        down = loss()
        net.p[name][at] = value
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


@pytest.fixture(scope="module")
def network():
    rng = random.Random(1)
    texts = [text(rng, w) for w in (EN, DE) for _ in range(100)]
    net = language.ByteNetwork(["de", "en"])
    net.fit([t.encode() for t in texts], np.array([1] * 100 + [0] * 100), steps=120)
    return net


def test_language_of_new_texts(network):
    rng = random.Random(2)
    texts = [text(rng, EN, 300), text(rng, DE, 300), text(rng, EN, 5), None, "", "12 34 !", "x"]
    lang, score = network.predict(texts)
    assert lang[:3] == ["en", "de", "en"] and lang[3:6] == ["und"] * 3 and lang[6] in ("en", "de")
    assert score[3:6].tolist() == [0, 0, 0] and (score[:3] > 0.8).all()
    again, same = network.predict([texts[0] for _ in range(3)])
    assert again == ["en"] * 3 and len(set(same.tolist())) == 1


def test_every_position_is_labelled(network):
    rng = random.Random(3)
    mixed = text(rng, EN, 100) + " " + text(rng, DE, 100)
    labels = network.positions(mixed)
    half = len(mixed.encode()) // 2
    assert len(labels) == len(mixed.encode()) and labels[: half - 150].mean() > 0.8 and labels[half + 150 :].mean() < 0.2


def test_language_of_odd_rows(spark, odd, network):
    got = language.identify(odd, network).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"de", "en", "und"}
    kept = language.keep_known(odd, network=network)
    assert kept.columns == odd.columns and kept.where(F.col("text").isNull() | (F.trim("text") == "")).count() == 0
    assert language.identify(odd.where(F.lit(False))).count() == 0
    unlabelled = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_kept_is_what_lies_in_languages(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, w), name) for i, (w, name) in enumerate(100 * [(EN, "en"), (DE, "de")])]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), noise=True)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    several = " ".join(text(rng, w, 12) for _ in range(5) for w in (EN, DE))
    texts = [text(rng, EN, 300), text(rng, DE, 20), several, several + noise[:100], "x", noise, noise[:60], "xqzjkwvbpf" * 40, "12 34 !", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in language.keep_known(docs, network=net).collect()) == [0, 1, 2, 3, 4]
    # Nothing is learned from rows without a language: every text with a letter stays.
    assert sorted(r.doc_id for r in language.keep_known(docs).collect()) == list(range(8))
    # Runs go on over windows, and a text's share does not hang on the texts beside it.
    alone = [net.shares([t.encode()])[0] for t in texts[:4]]
    assert np.allclose(net.shares([t.encode() for t in texts[:4]]), alone, atol=0.02)


def test_languages_that_are_null_are_filled_and_the_network_decides(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, w), name if i % 3 else None) for i, (w, name) in enumerate(120 * [(EN, "en"), (DE, "de")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.keep_known(docs).collect()
    assert len(kept) == len(rows) and all(r.lang == ("en" if r.doc_id % 2 == 0 else "de") for r in kept)
    # A network that takes everything for noise keeps nothing.
    blind = language.ByteNetwork(["de", "en", "und"])
    blind.p["b"][2] = 50
    assert language.keep_known(docs, blind).count() == 0


def test_letters_are_letters():
    net = language.ByteNetwork(["de", "en"])
    assert net.predict(["½ ² ①", "_", "é", "字"])[0][:2] == ["und", "und"] and "und" not in net.predict(["é", "字"])[0]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = language.identify(docs).join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.selectExpr("avg(CAST(lang_pred = lang AS INT)) AS a", "count(*) AS n").first()
    assert right.n > 100 and right.a >= 0.99
    # Some labels of these tables are noise: one in ten toxic ones marks a text without a toxic word.
    scored = toxicity.score(docs, labels).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out")
    right = scored.selectExpr("avg(CAST(predicted = toxic AS INT)) AS a", "count(*) AS n", "sum(toxic) AS t", "sum(toxic * predicted) AS hit").first()
    assert right.n > 50 and right.a >= 0.95 and right.hit >= 0.6 * right.t


BAD = ["scoundrel", "villainy", "rotten"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(EN) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_words_are_read_and_scored(spark, corpus):
    docs, labels = corpus
    scorer = toxicity.train(docs, labels)
    toxic = ["you scoundrel there", "you sc0undrel", "you s.c.o.u.n.d.r.e.l!", "you s c o u n d r e l now", "you scouuuundrel", "a r0773n one", "pure V1LLA1NY"]
    clean = ["the people look good", "call 555-7209 for a good time", "see a.b@c.example", "", None, "$$$ 100%"]
    assert (scorer.scores(toxic) >= 0.5).all(), scorer.scores(toxic)
    assert (scorer.scores(clean) < 0.5).all()
    assert scorer.restored("you sc0undrel, s c o u n d r e l") == "you scoundrel, scoundrel"
    scored = toxicity.score(docs, labels, scorer).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted <> toxic").count() == 0
    kept = toxicity.keep_clean(docs, labels, scorer)
    assert kept.columns == docs.columns and kept.join(labels, "doc_id").where("toxic = 1").count() == 0


def test_spaces_repeats_and_ends_are_in_the_lattice(spark, corpus):
    scorer = toxicity.train(*corpus)
    spaced = ["you scoun drel now", "a villa iny.", "sc oun drel", "you sc0un drel", "the rot ten one"]
    repeated = ["you sc000undrel", "a r00000tten one", "v1111lla1ny"]
    ends = ["a $coundrel", "that ro++en", "you $$coundrel!", "you scoundre|"]
    signs = ["you 5(0|_|nd23l or r0++3n"]
    letterless = toxicity.Scorer(scorer.channel, {"=that": 5.0})
    assert scorer.scores(spaced).min() >= 0.5, scorer.scores(spaced)
    assert scorer.scores(repeated).min() >= 0.5, scorer.scores(repeated)
    assert scorer.scores(ends).min() >= 0.5, scorer.scores(ends)
    assert scorer.scores(signs).min() >= 0.5, scorer.scores(signs)
    assert letterless.evidence(["say 7#47"])[0, 0] == 5.0 and letterless.evidence(["2024 555-7209"])[0, 0] == 0
    clean = ["the people look good", "call 555-7209 for 1000000 good people", "(look) over there!!!", "time 12:30, $$$ 100%", "I am at 10 to 4"]
    assert scorer.scores(clean).max() < 0.5, scorer.scores(clean)
    assert scorer.restored("a $coundrel, (the) good!!") == "a scoundrel, (the) good!!"


def test_toxicity_of_odd_rows(spark, odd, corpus):
    none = corpus[1].where(F.lit(False))
    got = toxicity.score(odd, none).collect()
    assert len(got) == odd.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.score(odd.where(F.lit(False)), none).count() == 0


def every_path(channel, token):
    """The best reading of a token among all paths through its lattice."""
    best = (-np.inf, "")
    for steps in itertools.product(*[channel.options(token, i) for i in range(len(token))]):
        context, score, out = (0, 0), 0.0, []
        for i, (symbol, cost) in enumerate([*steps, (0, 0.0)]):
            score -= cost
            if symbol >= 0:
                score += channel.lm[context[0], context[1], symbol]
                context = context[1], symbol
                if i < len(token):
                    out.append(chr(96 + symbol) if 0 < symbol < 27 else token[i] if symbol == 27 else " ")
        best = max(best, (score, " ".join("".join(out).split())))
    return best


def test_viterbi_finds_the_best_of_all_paths():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    s = toxicity.symbols("\n\n".join(EN + BAD))
    np.add.at(counts, (s[:-2] * 28 + s[1:-1]) * 28 + s[2:], 1)
    channel, rng = toxicity.Channel(counts), random.Random(9)
    tokens = ["r0++3n", "th@@@t", "f-r_o.m", "1*1|!", "x&yé5", "", "a"]
    tokens += ["".join(rng.choice("aehot01345@$!|+.-* é&") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    for token in map(toxicity.shortened, tokens):
        assert channel.restore([token])[0] == every_path(channel, token)[1], token


def test_only_tokens_without_evidence_are_not_read(spark, corpus):
    scorer, rng = toxicity.train(*corpus), random.Random(10)
    def disguise(w):
        return "".join(rng.choice([c, c, c, c + "-", c * 3, {"o": "0", "e": "3", "l": "|", "t": "7", "i": "1"}.get(c, c)]) for c in w)
    tokens = {disguise(rng.choice(EN + BAD)) + rng.choice(["", "!", "&co", "&rotten"]) for _ in range(400)}
    scorer.learn(tokens, scorer.value, True)
    expected = dict(scorer.memory)
    scorer.forget()
    scorer.learn(tokens, scorer.value, False)
    assert scorer.memory == expected and sum(v > 0 for v in expected.values()) > 20


def test_long_texts_take_time_in_proportion(spark, corpus):
    scorer = toxicity.train(*corpus)
    for long in ("a" * 1_000_000, "a " * 500_000, "5(0|_|nd23l" * 20_000):
        begin = time.process_time()
        assert scorer.scores([long])[0] < 0.5 or "5" in long
        assert time.process_time() - begin < 20


def test_conflicting_labels_have_one_result(spark, corpus):
    docs, labels = corpus
    more = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")).where("doc_id % 7 = 1"))
    one, two = (toxicity.train(docs, f) for f in (more, more.repartition(3).orderBy(F.desc("doc_id"))))
    assert one.weights == two.weights and one.curve == two.curve
