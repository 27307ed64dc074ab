"""Toxicity of deobfuscated text: a noisy channel over character lattices, then evidence from restored words.

A character language model counts trigrams over all documents. A token that may be disguised (leetspeak, separators
between letters, stretched letters, letters apart) is a lattice: each character can stand for itself, for what it is
used to imitate, or for nothing. The Viterbi path under channel costs and language model restores it; a token without
such characters has one path, itself. Marks and runs at a token's ends are dropped in one reading and read in another.
Neighbouring tokens are joined where that makes a word of evidence at a price. Words and word beginnings of restored text that occur far more often in toxic
than in other documents of a bounded labelled sample are evidence, and a logistic curve fitted on the same sample turns
a document's evidence into a score.

Edge cases: a null or empty text has no evidence and gets the score of such documents; without toxic and other labels
to learn from every score is 0; ids may be null or repeat; an empty table gives an empty result; other columns of the
input are not read (`score`) or come back as they are (`keep_clean`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from gridloom.llm.common import cut, let_go, small_batches

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 12_000
#: Pieces of evidence, at most; least share of the toxic documents that have one, least log odds, and least log
#: likelihood ratio: thousands of words are tried, and chance must not make one of them evidence.
MOST_FEATURES, LEAST_SHARE, LEAST_ODDS, LEAST_RATIO = 4096, 0.01, 4.3, 24.0
#: Fixed values of the channel: what a character may stand for.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "x",
    "*": "aeiou",
}
SEPARATORS = " .-_*~'^`,:;/\\"
#: Costs in nats: an imitation, a wildcard, a dropped separator, a kept symbol, a kept space, a space dropped by a join.
IMITATION, WILDCARD, DROPPED, KEPT, SPACE, JOIN = 0.5, 1.5, 0.2, 6.0, 4.0, 1.0
#: Tokens that are joined, at most: plain ones, and ones of which some are disguised, with so many characters together.
PLAIN_JOIN, ODD_JOIN, ODD_LENGTH = 4, 3, 16
#: A letter, or what imitates one, that repeats its predecessor, kept or dropped: the second of two, the second of more, and further ones.
REPEATS = {"pair": (0.0, 2.0), "second": (2.0, 0.0), "further": (9.0, 0.0)}
OPENING = "\"'([{<«„“”‘’¿.,;:?"
CLOSING = "\"')]}>»„“”‘’….,;:?!"
EDGE_RUN = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
STRETCHED = re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Characters of a long token that are read at a time, and of its neighbours on either side.
PART, BESIDE = 64, 16
#: What no letter, digit or imitation is, at the ends of a token.
ENDS = "".join(c for c in OPENING + CLOSING if c not in IMITATES)
SIGNS = re.compile("[" + re.escape("".join(IMITATES) + SEPARATORS) + "]+")
SIGN = re.compile("[" + re.escape("".join(IMITATES) + SEPARATORS) + "]")
#: Symbols of the language model: 0 for what is no letter, a to z, 27 for any other letter.
SYMBOLS = 28
MEMORY = 200_000

_class = np.array([27 if chr(c).isalpha() and c > 0x7F else 0 for c in range(0x3000)] + [27], np.uint8)
for _c in range(26):
    _class[97 + _c] = _class[65 + _c] = _c + 1


def is_learned(doc_id: Column) -> Column:
    """Documents whose labels may be learned from; the others, and those without an id, are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _class[np.minimum(points, 0x3000)].astype(np.int32)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts, boundaries between texts included."""

    def count(batches):
        let_go()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for group in grouped([t for t in batch.column("text").to_pylist() if t], len):
                s = symbols("\n\n".join(["", *group, ""]))
                for i in range(0, max(0, len(s) - 2), 1 << 20):
                    part = s[i : i + (1 << 20) + 2]
                    total += np.bincount((part[:-2] * SYMBOLS + part[1:-1]) * SYMBOLS + part[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["trigram", "n"])

    small_batches(docs.sparkSession)
    counts = np.zeros(SYMBOLS**3, np.int64)
    # At most SYMBOLS**3 rows, whatever the number of documents.
    for row in docs.select("text").mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[row["trigram"]] = row["n"]
    return counts


class Channel:
    """Restores disguised tokens under a trigram model."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two = three.sum(0)
        lower = (two + 0.5) / (two.sum(1, keepdims=True) + 0.5 * SYMBOLS)
        self.lm = np.log((three + 5 * lower[None]) / (three.sum(2, keepdims=True) + 5))
        self.flat = self.lm.ravel().tolist()

    @staticmethod
    def options(token: str, i: int) -> list[tuple[int, float]]:
        """(symbol, cost) of what the character at i may stand for; symbol -1 is nothing. Runs are at most three long."""
        c = token[i]
        symbol = int(_class[min(ord(c), 0x3000)])
        keep, drop = 0.0, None
        if i and token[i - 1] == c and (symbol or c in IMITATES):
            second = i < 2 or token[i - 2] != c
            keep, drop = REPEATS["further" if not second else "second" if token[i + 1 : i + 2] == c else "pair"]
        if symbol:
            return [(symbol, keep)] if drop is None else [(symbol, keep), (-1, drop)]
        found = [(ord(x) - 96, keep + (WILDCARD if c == "*" else IMITATION)) for x in IMITATES.get(c, "")]
        if drop is not None and c not in SEPARATORS:
            found.append((-1, drop))
        if c in SEPARATORS:
            found.append((-1, WILDCARD if c == "*" else DROPPED))
        return [*found, (0, SPACE if c == " " else KEPT)]

    def restore(self, tokens: list[str]) -> list[str]:
        """The best reading of each token, words apart by single spaces; tokens are in lower case."""
        return [" ".join("".join(c for part in self.parts(t) for c in self.path(*part)).split()) for t in map(shortened, tokens)]

    @staticmethod
    def parts(token: str) -> list[tuple[str, int, int]]:
        """(part, begin, end): a long token is read in parts, each with some characters of its neighbours beside it."""
        return [
            (token[max(0, i - BESIDE) : i + PART + BESIDE], min(i, BESIDE), min(i, BESIDE) + PART) for i in range(0, max(1, len(token)), PART)
        ]

    def price(self, text: str) -> float:
        """Of a text between spaces under the model, in nats."""
        s = np.r_[0, 0, symbols(text), 0]
        return -float(self.lm[s[:-2], s[1:-1], s[2:]].sum())

    def path(self, token: str, begin: int = 0, end: int = PART) -> list[str]:
        """What the characters from begin to end write on the Viterbi path through the lattice of a token.

        A state is the last two symbols written; there are as many as the last characters can have written.
        """
        lm, states = self.flat, {0: (0.0, None)}
        for t in range(len(token) + 1):
            options = self.options(token, t) if t < len(token) else [(0, 0.0)]
            new: dict[int, tuple] = {}
            for state, (score, written) in states.items():
                below = state % SYMBOLS * SYMBOLS
                for symbol, cost in options:
                    if symbol < 0:
                        key, value = state, score - cost
                    else:
                        key, value = below + symbol, score - cost + lm[state * SYMBOLS + symbol]
                    if key not in new or value > new[key][0]:
                        new[key] = (value, written if symbol < 0 else (written, t, symbol))
            states = new
        written, out = max(states.values(), key=lambda x: x[0])[1], []
        while written:
            written, t, s = written
            if begin <= t < end and t < len(token):
                out.append(chr(96 + s) if 0 < s < 27 else token[t] if s == 27 else " ")
        return out[::-1]


def shortened(token: str) -> str:
    """Runs of one character are three long at most: further ones are always dropped."""
    return RUN.sub(r"\1\1\1", token)


def stripped(token: str) -> str:
    """A token without the marks around it and without runs of one symbol at its ends."""
    return EDGE_RUN.sub("", token.lstrip(OPENING).rstrip(CLOSING)).lstrip(OPENING).rstrip(CLOSING)


def disguised(bare: str) -> bool:
    """Whether a stripped token in lower case has more than one path that matters."""
    if bare.isalpha():
        return bool(STRETCHED.search(bare))
    return len(bare) > 2 and bool(SIGN.search(bare) or STRETCHED.search(bare)) and (any(map(str.isalpha, bare)) or bool(SIGNS.fullmatch(bare)))


def whole(words: list[str]) -> list[str]:
    """Words of which only the whole is evidence: tokens without a letter and joined ones are often read by chance."""
    return ["=" + w for w in words]


def features(word: str) -> list[str]:
    if word.startswith("="):
        return [word] if len(word) > 3 else []
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5) if len(word) > n)] if len(word) > 2 else []


class Scorer:
    """Evidence in a text, with a bounded memory of tokens seen before."""

    def __init__(self, channel: Channel, weights: dict[str, float] | None = None, curve: tuple[float, ...] = ()):
        self.channel, self.weights, self.curve = channel, weights or {}, curve
        self.words = frozenset(f[1:] for f in self.weights if f[0] == "=")
        self.prefixes = frozenset(w[:n] for w in self.words for n in range(len(w) + 1))
        heads = {f[1:] for f in self.weights}
        self.heads, self.ahead = frozenset(heads), frozenset(w[:n] for w in heads for n in range(len(w) + 1))
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, object] = {}
        self.bare: dict[str, str] = {}
        self.starts: set[str] = set()
        self.odd: set[str] = set()

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "bare": {}, "starts": set(), "odd": set()}

    def value(self, words: list[str]):
        return max((self.weights.get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def parts(self, text: str) -> list[str]:
        """The tokens of a text, letters that stand apart joined into one."""
        tokens = text.lower().split()
        if sum(len(t) == 1 for t in tokens) > 2:
            return tokens + APART.findall(" ".join(tokens))
        return tokens

    def joined(self, tokens: list[str]) -> list[str]:
        """The words of evidence that neighbouring tokens make, where these are likelier than the tokens at the price of
        the spaces."""
        found, bare, price = {}, self.bare, self.channel.price
        if not self.starts.isdisjoint(tokens):
            for i in [i for i, t in enumerate(tokens) if t in self.starts]:
                word = bare[tokens[i]]
                for n in range(2, PLAIN_JOIN + 1):
                    if i + n > len(tokens) or (word := word + bare[tokens[i + n - 1]]) not in self.prefixes:
                        break
                    if word in self.words:
                        found[tuple(bare[t] for t in tokens[i : i + n])] = word
        if not self.odd.isdisjoint(tokens):
            signed = [i for i, t in enumerate(tokens) if t in self.odd]
            windows = {tuple(tokens[j : j + n]) for i in signed for n in range(2, ODD_JOIN + 1) for j in range(max(0, i - n + 1), min(i, len(tokens) - n) + 1)}
            for window in windows:
                own = tuple(bare[t] for t in window)
                if self.may_join(own) and (word := self.channel.restore(["".join(own)])[0]) in self.words:
                    found[tuple(self.channel.restore(list(own)))] = word
        return [w for x, w in found.items() if price(w) + JOIN * (len(x) - 1) < price(" ".join(x))]

    def may_join(self, window: tuple[str, ...]) -> bool:
        """Whether tokens, some of them disguised, can make a word of evidence."""
        if sum(map(len, window)) > ODD_LENGTH or not all(window) or not any(c.isalpha() for t in window for c in t):
            return False
        return any(node in self.words for node in spelled("".join(window), self.prefixes))

    def may_hit(self, token: str) -> bool:
        """Whether some reading of a token has a word that is, or begins with, evidence."""
        return any(not self.heads.isdisjoint(nodes) for nodes in begun(token, self.ahead))

    def learn(self, tokens: set[str], value, everything: bool) -> None:
        """Restores new tokens and keeps what value() makes of their words; unless everything is asked, only of those
        with a reading that has evidence."""
        for token in tokens:
            if token in self.memory:
                continue
            plain, bare = stripped(token), token.strip(ENDS)
            words = [plain] if plain.isalpha() else [w for w in re.split(r"[\W\d_]+", plain) if w]
            for x in {plain: 1, bare: 1}:
                if disguised(x) and (everything or self.may_hit(x)):
                    words += self.channel.restore([x])[0].split() if any(map(str.isalpha, x)) else whole(self.channel.restore([x])[0].split())
            self.memory[token] = value(words)
            self.bare[token] = bare
            if bare in self.prefixes:
                self.starts.add(token)
            if not bare.isalpha() and len(bare) < ODD_LENGTH and SIGN.search(bare):
                self.odd.add(token)

    def look_up(self, texts: list[str | None], value, everything: bool = False) -> tuple[list[list], list[list[str]]]:
        """value() of the distinct tokens of each text, and its tokens in order."""
        split = [self.parts(t) if t else [] for t in texts]
        distinct = [set(x) for x in split]
        new = set().union(*distinct)
        if len(self.memory) + len(new) > MEMORY:
            self.forget()
        self.learn(new, value, everything)
        get = self.memory.__getitem__
        return [list(map(get, tokens)) for tokens in distinct], split

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The strongest weight in each text, the logarithm of one more than the number of tokens with any, and of one more
        than the sum of their weights."""
        out = []
        for group in grouped(texts, len0):
            for values, tokens in zip(*self.look_up(group, self.value), strict=True):
                hits = [v for v in (*values, *(self.value(whole([w])) for w in self.joined(tokens))) if v]
                out.append((max(hits, default=0.0), np.log1p(len(hits)), np.log1p(sum(hits))))
        return np.array(out).reshape(-1, 3)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(texts))
        x = self.evidence(texts)
        return np.round(1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30))), 6)

    def restored(self, text: str | None) -> str | None:
        """The text in lower case with disguised tokens read."""
        if not text:
            return text

        def read(found: re.Match) -> str:
            bare, ends = stripped(found[0]), found[0].strip(ENDS)
            # Marks at the ends are read only where that makes a word of evidence.
            if ends != bare and disguised(ends) and self.channel.restore([ends])[0] in self.words:
                bare = ends
            return found[0].replace(bare, self.channel.restore([bare])[0]) if disguised(bare) else found[0]

        return re.sub(r"\S+", read, APART.sub(lambda m: self.channel.restore([m[0]])[0], text.lower()))


def spelled(text: str, prefixes: frozenset[str]) -> set[str]:
    """What a text may spell of words with these prefixes, each character being a letter, an imitation or nothing."""
    nodes, last = {""}, ""
    for c in text:
        letters = c if c.isalpha() else IMITATES.get(c, "")
        more = {n + x for n in nodes for x in letters if n + x in prefixes}
        nodes = more | nodes if c in SEPARATORS or c == last else more
        if not nodes:
            break
        last = c
    return nodes


def begun(token: str, prefixes: frozenset[str]) -> Iterator[set[str]]:
    """All beginnings of words that a token may spell, from its start or from behind a sign, after each character."""
    nodes, last = {""}, ""
    for c in shortened(token):
        letters = c if c.isalpha() else IMITATES.get(c, "")
        more = {n + x for n in nodes for x in letters if n + x in prefixes}
        nodes = more | nodes if c in SEPARATORS or c == last else more
        if not c.isalpha():
            nodes.add("")
        yield nodes
        last = c


def len0(text: str | None) -> int:
    return len(text or "")


def grouped(rows: list, size, most: int = 1_000_000):
    """Rows in groups of which all but the last reach `most` together."""
    group, held = [], 0
    for x in rows:
        group.append(x)
        held += size(x)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a constant and the columns of x, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer whose language model covers all docs and whose classifier a bounded sample of labels."""
    spark = docs.sparkSession
    scorer = Scorer(Channel(trigram_counts(docs)))
    known = labels.where(F.col("toxic").isin(0, 1) & is_learned(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return scorer
    # Where ids or texts have several labels the greatest counts, whatever the order of rows.
    place = F.xxhash64("doc_id", F.lit("toxic"))
    drawn = known.where(F.pmod(place, F.lit(1_000_000)) < (1_000_000 if n <= sample else 1_100_000 * sample // n))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(place, "doc_id").limit(sample)
    drawn = F.broadcast(drawn)  # `sample` rows of two numbers at most
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(drawn, "doc_id")
    rows = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    shared = spark.sparkContext.broadcast(scorer)

    def found(batches):
        own = shared.value
        for batch in batches:
            for group in grouped(list(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)), lambda x: len(x[0])):
                own.forget()
                values, _ = own.look_up([t for t, _ in group], lambda words: [f for w in words for f in features(w)], everything=True)
                own.forget()
                pairs = [(f, y) for lists, (_, y) in zip(values, group, strict=True) for f in {f for x in lists for f in x}]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], names=["feature", "toxic"])

    per_class = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = per_class.get(1, 0), per_class.get(0, 0)
    if not n1 or not n0:
        return scorer
    counted = rows.mapInArrow(found, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    both = F.col("a") + F.col("b")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n1 + n0) / (both * n))).otherwise(0.0)
    ratio = 2 * (part("a", n1) + part("b", n0))
    chosen = counted.where((F.col("a") >= max(3, LEAST_SHARE * n1)) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).select("feature", odds.alias("odds"))
    best = chosen.orderBy(F.desc("odds"), "feature").limit(MOST_FEATURES).collect()
    scorer = Scorer(scorer.channel, {r["feature"]: r["odds"] for r in best})
    with_weights = spark.sparkContext.broadcast(scorer)

    def measured(batches):
        for batch in batches:
            x = with_weights.value.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("toxic")], names=["x", "n", "s", "toxic"])

    fitted = np.array([tuple(r) for r in rows.mapInArrow(measured, "x double, n double, s double, toxic int").collect()], float)
    fitted = fitted[np.lexsort(fitted.T)]  # one order, whatever came first
    scorer.curve = logistic(fitted[:, :3], fitted[:, 3])
    return scorer


def column(docs: DataFrame, scorer: Scorer):
    """A column function: text to score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # trigrams and MOST_FEATURES weights: under 1 MB

    @pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        let_go()
        return pd.Series(shared.value.scores(texts.tolist()))

    return scored


def restorer(docs: DataFrame, scorer: Scorer):
    """A column function: text to restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @pandas_udf(StringType())
    def restored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.restored(t) for t in texts])

    return restored


def score(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    scored = column(docs, scorer or train(docs, labels))
    rows = docs.select("doc_id", (~is_learned(F.col("doc_id"))).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """The columns of docs; documents that are predicted toxic go."""
    scored = column(docs, scorer or train(docs, labels))
    return docs.where(scored(docs["text"]) < 0.5)
