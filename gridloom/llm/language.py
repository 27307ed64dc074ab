"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a text in both directions, labels every position with a language and pools the positions
into document probabilities. It is trained by backpropagation through time on windows drawn at random from passages of
a bounded sample of labelled documents, PASSAGES of them at hashed places all over a text; all documents are then
labelled in full. Long texts are read as windows that
carry some context on both sides, many windows at a time, so that memory is bounded whatever a text's length.

Edge cases: a null text or one without a letter is `und` with score 0; without labelled documents every text is `und`;
documents with a null language are not learned from; where nothing is learned, `keep_known` keeps every text with a
letter; `keep_known` fills a null language with the predicted one if the input has a column `lang`; repeated rows get equal results; an empty table gives an empty result; other columns of the input are not read
(`identify`) or come back as they are (`keep_known`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from gridloom.llm.common import let_go, small_batches

#: Labelled documents that the network is fitted on, at most.
SAMPLE = 1500
#: Passages of a sampled text that windows are drawn from, and characters of each.
PASSAGES, PASSAGE = 8, 250
HIDDEN = 10
WINDOW, BATCH, STEPS, RATE = 48, 128, 260, 0.02
#: Bytes that a window labels when reading, and its context on either side.
CORE, CONTEXT = 224, 16
#: Windows read at a time.
LANES = 1024
#: Least probability of a position's label, least run of positions with one label, and least share of a kept document's
#: positions in such runs. Documents in several languages have as many of these as others, whatever their pooled ones.
SURE, RUN, ENOUGH = 0.4, 8, 0.1
#: Mean probability of noise below which a document is kept all the same: short clean ones often have no such run.
NOISE = 0.96
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
KNOWN = StructType([StructField("kept", BooleanType()), StructField("lang", StringType())])


def is_learned(doc_id: Column) -> Column:
    """Documents that may be learned from; the others, and those without an id, are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Two gated recurrent units, one for each direction, and a softmax over both states at every position.

    E: what a byte gives to the gates (256 bytes and padding); U: what the state gives to the update and reset gates;
    V: what the reset state gives to the candidate; W, b: the labels.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, h, c = languages, hidden, len(languages)
        scale = 1 / np.sqrt(h)
        self.p = {
            "E": rng.normal(0, 0.3, (2, 257, 3 * h)), "U": rng.normal(0, scale, (2, h, 2 * h)), "V": rng.normal(0, scale, (2, h, h)),
            "W": rng.normal(0, scale, (2 * h, c)), "b": np.zeros(c),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, keep: bool = False):
        """States of both directions for bytes x (T, B): (T, B, 2h), and what the backward pass needs."""
        e, u, v = self.p["E"], self.p["U"], self.p["V"]
        t, n = x.shape
        h = u.shape[1]
        out = np.empty((t, n, 2 * h), np.float32)
        state, kept = np.zeros((2, n, h), np.float32), []
        for i in range(t):
            given = np.stack([e[0][x[i]], e[1][x[t - 1 - i]]])
            gates = sigmoid(given[:, :, : 2 * h] + state @ u)
            z, r = gates[:, :, :h], gates[:, :, h:]
            reset = r * state
            new = np.tanh(given[:, :, 2 * h :] + reset @ v)
            if keep:
                kept.append((state, z, r, reset, new))
            state = state + z * (new - state)
            out[i, :, :h], out[t - 1 - i, :, h:] = state[0], state[1]
        return out, kept

    def labels(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["W"] + self.p["b"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(-1, keepdims=True)

    def scan(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (T, labels, B) for bytes x (T, B): `labels` of `states`, with windows along the last axis,
        where numpy's loops are long, and all steps in the same memory."""
        h, (t, n) = self.p["U"].shape[1], x.shape
        # A gate is (tanh(a / 2) + 1) / 2; halving what it is given is exact.
        half = np.r_[np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)][:, None]
        e = np.ascontiguousarray(self.p["E"].transpose(0, 2, 1)) * half
        u, v = np.ascontiguousarray(self.p["U"].transpose(0, 2, 1)) * half[: 2 * h], np.ascontiguousarray(self.p["V"].transpose(0, 2, 1))
        out = np.empty((t, 2 * h, n), np.float32)
        given, gates = np.empty((2, 3 * h, n), np.float32), np.empty((2, 2 * h, n), np.float32)
        state, reset, new = np.zeros((2, h, n), np.float32), np.empty((2, h, n), np.float32), np.empty((2, h, n), np.float32)
        for i in range(t):
            for k, at in enumerate((i, t - 1 - i)):
                np.take(e[k], x[at], axis=1, out=given[k], mode="clip")
            np.matmul(u, state, out=gates)
            gates += given[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[:, h:], state, out=reset)
            np.matmul(v, reset, out=new)
            new += given[:, 2 * h :]
            np.tanh(new, out=new)
            new -= state
            new *= gates[:, :h]
            state += new
            out[i, :h], out[t - 1 - i, h:] = state[0], state[1]
        logits = np.ascontiguousarray(self.p["W"].T) @ out
        logits += self.p["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the positions that are not padding, by backpropagation through time."""
        t, n = x.shape
        u, v, w = self.p["U"], self.p["V"], self.p["W"]
        h = u.shape[1]
        states, kept = self.states(x, keep=True)
        error = self.labels(states)
        error[:, np.arange(n), y] -= 1
        real = (x < 256)[:, :, None]
        error *= real / real.sum()
        g = {"W": np.einsum("tnh,tnc->hc", states, error), "b": error.sum((0, 1)), "E": np.zeros_like(self.p["E"]), "U": np.zeros_like(u), "V": np.zeros_like(v)}
        down = error @ w.T
        back = np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            state, z, r, reset, new = kept[i]
            back = back + np.stack([down[i, :, :h], down[t - 1 - i, :, h:]])
            d_new = back * z * (1 - new**2)
            d_z = back * (new - state) * z * (1 - z)
            d_reset = d_new @ v.transpose(0, 2, 1)
            d_r = d_reset * state * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=2)
            g["U"] += state.transpose(0, 2, 1) @ d_gates
            g["V"] += reset.transpose(0, 2, 1) @ d_new
            for k, at in enumerate((i, t - 1 - i)):
                np.add.at(g["E"][k], x[at], np.concatenate([d_gates[k], d_new[k]], axis=1))
            back = back * (1 - z) + d_reset * r + d_gates @ u.transpose(0, 2, 1)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """Adam over windows at random places of texts, every language as often. A label that no text has is noise's."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        anything = np.arange(len(texts))
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(of), BATCH)
            x = np.full((WINDOW, BATCH), 256)
            for lane, k in enumerate(y):
                own = of[k] if len(of[k]) else anything
                text = texts[own[rng.integers(len(own))]]
                at = rng.integers(0, max(1, len(text) - WINDOW + 1))
                part = text[at : at + rng.integers(WINDOW // 4, WINDOW + 1)]
                if own is anything:
                    part = scrambled(part, rng)
                x[: len(part), lane] = np.frombuffer(part, np.uint8)
            rate = RATE * min(1, 4 * (1 - step / (steps + 1)))
            for k, d in self.gradients(x, y).items():
                np.clip(d, -1, 1, out=d)
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                self.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def read(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Every byte of texts, once: for each block of windows their texts, places, what they label and probabilities
        (T, labels, B)."""
        spans = np.array([(k, at) for k, t in enumerate(texts) for at in range(0, len(t), CORE)], int).reshape(-1, 2)
        sizes = np.array([len(t) for t in texts], int)
        begin = np.maximum(0, spans[:, 1] - CONTEXT)
        reach = np.minimum(sizes[spans[:, 0]], spans[:, 1] + CORE + CONTEXT) - begin
        order = np.argsort(reach, kind="stable")
        for i in range(0, len(order), LANES):
            lanes = order[i : i + LANES]
            x = np.full((int(reach[lanes[-1]]), len(lanes)), 256)
            for lane, j in enumerate(lanes.tolist()):
                x[: reach[j], lane] = np.frombuffer(texts[spans[j, 0]], np.uint8, reach[j], begin[j])
            place = begin[lanes] + np.arange(len(x))[:, None]
            own = (place >= spans[lanes, 1]) & (place < spans[lanes, 1] + CORE) & (x < 256)
            yield spans[lanes, 0], place, np.where(own, x, 256), self.scan(x)

    def positions(self, text: str) -> np.ndarray:
        """The number of the language at every byte of a text."""
        found = np.zeros(len(text.encode()), int)
        for _, place, x, labels in self.read([text.encode()]):
            found[place[x < 256]] = labels.argmax(1)[x < 256]
        return found

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Document probabilities: the mean over all positions, those of ASCII space and below aside."""
        return self.judged(texts)[0]

    def judged(self, texts: list[bytes], runs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Document probabilities, and with `runs` the share of each text's positions, those of ASCII space and below aside,
        in runs of RUN or more that are surely in one language; 1 for shorter texts, which show too little. Runs go on
        over the windows of a text."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], int)
        begin = np.cumsum(sizes) - sizes
        label = np.full(int(sizes.sum()) if runs else 0, -2, np.int16)
        none = self.languages.index(UNKNOWN) if UNKNOWN in self.languages else -1
        for text, place, x, labels in self.read(texts):
            counted = (x > 32) & (x < 256)
            np.add.at(total, text, np.einsum("tcn,tn->cn", labels, counted.astype(np.float32)).T)
            if runs:
                best, top = np.zeros(x.shape, np.int16), labels[:, 0].copy()
                for k in range(1, labels.shape[1]):
                    best[labels[:, k] > top] = k
                    np.maximum(top, labels[:, k], out=top)
                sure = (top >= SURE) & (best != none)
                label[(begin[text] + place)[counted]] = np.where(sure, best, -1)[counted]
        total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
        if not runs:
            return total, None
        at = np.flatnonzero(label > -2)
        label, of = label[at], np.repeat(np.arange(len(texts)), sizes)[at]
        first = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (of[1:] != of[:-1])][: len(label)])
        length = np.diff(np.r_[first, len(label)])
        counted = np.bincount(of, minlength=len(texts))
        good = (label[first] >= 0) & (length >= RUN)
        inside = np.bincount(of[first], np.where(good, length, 0), len(texts))
        return total, np.where(counted < RUN, 1.0, inside / np.maximum(counted, 1))

    def shares(self, texts: list[bytes]) -> np.ndarray:
        return self.judged(texts, runs=True)[1]

    def known(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """Whether each text has a letter and enough of it is in languages, and the likeliest language of those; without
        languages letters are enough."""
        kept = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
        lang: list[str | None] = [None] * len(texts)
        real = [k for k, x in enumerate(self.languages) if x != UNKNOWN]
        if real:
            for group in grouped(np.flatnonzero(kept).tolist(), texts):
                pooled, shares = self.judged([texts[i].encode("utf-8", "replace") for i in group], runs=True)
                noise = 1 - pooled[:, real].sum(1)
                kept[group] = (shares >= ENOUGH) | (len(real) < len(self.languages)) & (noise < NOISE)
                for i, k in zip(group, pooled[:, real].argmax(1).tolist(), strict=True):
                    lang[i] = self.languages[real[k]]
        return kept, lang

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if self.languages and t and LETTER.search(t)]
        for group in grouped(asked, texts):
            p = self.pooled([texts[i].encode("utf-8", "replace") for i in group])
            for i, k, s in zip(group, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                lang[i], score[i] = self.languages[k], min(1.0, round(s, 6))
        return lang, score


def scrambled(part: bytes, rng: np.random.Generator) -> bytes:
    """Noise: the bytes of a text in another order, or random letters in words of random lengths."""
    if rng.integers(2):
        return rng.permutation(np.frombuffer(part, np.uint8)).tobytes()
    letters = rng.integers(97, 123, len(part)) - 32 * (rng.random(len(part)) < rng.choice([0, 0.1, 1]))
    return np.where(rng.random(len(part)) < rng.choice([0, 0.15, 0.3]), 32, letters).astype(np.uint8).tobytes()


def grouped(numbers: list[int], texts: list[str], chars: int = 2_000_000) -> Iterator[list[int]]:
    group, held = [], 0
    for i in numbers:
        group.append(i)
        held += len(texts[i])
        if held >= chars:
            yield group
            group, held = [], 0
    if group:
        yield group


def train(docs: DataFrame, sample: int = SAMPLE, noise: bool = False) -> ByteNetwork:
    """A network fitted on at most `sample` documents that may be learned from, spread over the languages; with `noise`
    scrambled ones of them are learned as no language."""
    known = docs.select("doc_id", "text", "lang").where(is_learned(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    # One row for each language: codes of languages are a list of some thousands at most.
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return ByteNetwork([])
    languages, each = sorted(r["lang"] for r in sizes), -(-sample // len(sizes))
    # Each language gives its share by a hash of the id, so no task sorts a language's documents.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1_000_000, 1_500_000 * each // r["count"] + 1))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")))
    # Passages of a longer text are enough: training draws windows from them.
    at = lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1) + 1
    passages = F.transform(F.sequence(F.lit(1), F.lit(PASSAGES)), lambda k: F.substring("text", at(k).cast("int"), F.lit(PASSAGE)))
    rows = drawn.select("lang", passages.alias("texts")).limit(2 * sample).collect()
    number = {x: k for k, x in enumerate(languages)}
    rows = sorted({(r["lang"], t) for r in rows for t in r["texts"]})  # one order, whatever came first
    languages = [x for x in languages if any(r[0] == x for r in rows)]
    number = {x: k for k, x in enumerate(languages)}
    network = ByteNetwork(languages + [UNKNOWN] * (noise and languages != [] and UNKNOWN not in languages))
    if languages:
        network.fit([t.encode("utf-8", "replace") for _, t in rows], np.array([number[x] for x, _ in rows]))
    return network


def predictor(docs: DataFrame, network: ByteNetwork):
    """A column function: text to (lang, score)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few hundred KB, fixed by HIDDEN and the languages

    @pandas_udf(RESULT)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        let_go()
        lang, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score})

    return predicted


def identify(docs: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs."""
    predicted = predictor(docs, network or train(docs))
    rows = docs.select("doc_id", (~is_learned(F.col("doc_id"))).alias("held_out"), predicted("text").alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def keep_known(docs: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """The columns of docs; documents without a letter go, and those of which too little is surely in a language and nearly
    all is noise to the network. A null in a column `lang` becomes the predicted language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or train(docs, noise=True))

    @pandas_udf(KNOWN)
    def known(texts: pd.Series) -> pd.DataFrame:
        let_go()
        kept, lang = shared.value.known(texts.tolist())
        return pd.DataFrame({"kept": kept, "lang": lang})

    # Read once for both what stays and its language.
    judged = docs.withColumn("__known", known.asNondeterministic()(docs["text"])).where("__known.kept")
    if "lang" in docs.columns and dict(docs.dtypes)["lang"] == "string":
        judged = judged.withColumn("lang", F.coalesce(docs["lang"], F.col("__known.lang")))
    return judged.drop("__known")
