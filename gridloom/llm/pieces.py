"""Token ids of whole texts, from the tokenizers library, with a bounded memory of pieces seen before.

A single space between two characters that are not white space always begins a new word for the tokenizers used here:
none of their patterns joins what stands before such a space to what follows, and none looks behind. So a text's ids
are the ids of the pieces between such spaces, one after another, and a piece met again need not be encoded again.
Special strings contain no space, so they stay inside a piece and are handled as the library does by default.

A new piece that is one plain word, or two on two lines, with marks behind them or none, goes straight to the library's model, spelled as the
library's normaliser and pre-tokeniser spell its letters; any other goes through the whole library.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from gridloom.llm.common import held

os.environ["TOKENIZERS_PARALLELISM"] = "false"

SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that normalisers and pre-tokenisers treat one by one, and marks that always begin a word of their own.
LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
MARKS = ".,;:!?$&*%#"
#: A word and marks behind it, and maybe the same once more on the next line.
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]{{0,4}})(?:\n([{LETTERS}]+)([{MARKS}]{{0,4}}))?")
PROBES = ("Word", "stra\u00dfe,", "\u00c9l\u00e8ve.", "ni\u00f1o", "I!", "\u00dcber", "don", "s", "word,$$$", "it.\nWord", "x\ny%%%", "\u00e9!?\n\u00c9l\u00e8ve#")
#: Words that begin a line are remembered up to this many.
MOST_STARTS = 50_000
#: Special strings are at most so long.
LONGEST_SPECIAL = 32
#: When the memory holds more pieces or characters than these, it keeps the short ones that were met again.
MOST_PIECES = 600_000
MOST_CHARS = 32_000_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 500_000


def encoder(path: str, memory: int = 1) -> PieceEncoder:
    """The encoder of this Python worker; another file or operator takes its place."""
    return held(("encoder", path, memory), lambda: PieceEncoder(path, memory))


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of batches, so many rows at a time, since Python strings beside whole batches take much memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.column("doc_id").slice(at, rows).to_pylist(), batch.column("text").slice(at, rows).to_pylist()



class _Numbers(dict):
    """Gives each new key the next number and lists it as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Marks(dict):
    """Ids of marks that stand together, and of a new line between words, as the library gives them."""

    def __init__(self, tokenizer):
        super().__init__({"": []})
        self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, marks: str) -> list[int]:
        a, both = self.ids("a"), self.ids("a" + marks + ("a" if marks == "\n" else ""))
        found = self[marks] = both[len(a) : len(both) - len(a) if marks == "\n" else None]
        return found


class PieceEncoder:
    def __init__(self, path: str, memory: int = 1):
        """memory: so many times MOST_PIECES and MOST_CHARS are remembered."""
        from tokenizers import Tokenizer

        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.check_specials()
        self.model = self.tokenizer.model
        self.forget()
        self.spelling = self.spelt()

    def check_specials(self) -> None:
        """Pieces and chunks may be cut beside white space only where no special string reaches over it."""
        for x in self.tokenizer.get_added_tokens_decoder().values():
            if x.lstrip or x.rstrip or len(x.content) > LONGEST_SPECIAL or any(map(str.isspace, x.content)):
                raise ValueError(f"special string {x.content!r} strips or has white space, or is above {LONGEST_SPECIAL} characters")

    def spelt(self) -> tuple[dict[int, str], str, _Marks] | None:
        """How letters and a space before a word are spelled, and ids of marks and of a new line; None if words aren't spelled so."""
        t = self.tokenizer
        tidy = t.normalizer.normalize_str if t.normalizer else str
        shown = lambda x: [w for w, _ in t.pre_tokenizer.pre_tokenize_str(tidy(x))]
        letters = {ord(c): shown(c)[0] for c in LETTERS}
        space = shown(" a")[0].removesuffix(letters[ord("a")])
        spelling = letters, space, _Marks(t)
        for p in PROBES:
            for q in (p, " " + p):
                if self.plain(spelling, q, *PLAIN.fullmatch(p).groups()) != t.encode(q, add_special_tokens=False).ids:
                    return None
        return spelling

    def plain(self, spelling, piece: str, word: str, mark: str, word2: str | None = None, mark2: str | None = None) -> list[int]:
        letters, space, marks = spelling
        ids = self.word(spelling, word, piece[0] == " ") + marks[mark]
        return ids if word2 is None else [*ids, *marks["\n"], *self.word(spelling, word2, False), *marks[mark2]]

    def word(self, spelling, word: str, spaced: bool) -> list[int]:
        letters, space, _ = spelling
        spelled = word.translate(letters)
        return [x.id for x in self.model.tokenize(space + spelled if spaced else spelled)]

    def known(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of those words behind a space that were encoded before."""
        get, count = self.numbers.get, len(self.start)
        numbers = {w: n for w in words if 0 <= (n := get(w, -1)) < count}
        n = np.fromiter(numbers.values(), np.int64, len(numbers))
        length = self.length[n]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(self.start[n] - (ends - length), length) + np.arange(int(length.sum()))].tolist()
        return {w: flat[b - k : b] for w, b, k in zip(numbers, ends.tolist(), length.tolist(), strict=True)}

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        """The ids of new pieces."""
        out: list = [None] * len(pieces)
        if self.spelling:
            spelling, marks = self.spelling, self.spelling[2]
            matches = [PLAIN.fullmatch(p, 1 if p[:1] == " " else 0) for p in pieces]
            # Looked up all at once; where nothing follows a word it is new.
            words: dict = self.known({m[1] for m in matches if m and m.start() and m.end() > m.end(1)})
            for i, (piece, found) in enumerate(zip(pieces, matches, strict=True)):
                if found:
                    spaced = piece[:1] == " "
                    word, mark, word2, mark2 = found.groups()
                    stem = word if spaced else (word,)
                    ids = words.get(stem)
                    if ids is None:
                        ids = words[stem] = self.word(spelling, word, spaced)
                    if mark:
                        ids = ids + marks[mark]
                    if word2:
                        begun = self.starts.get(word2)
                        if begun is None:
                            if len(self.starts) >= MOST_STARTS:
                                self.starts.clear()
                            begun = self.starts[word2] = self.word(spelling, word2, False)
                        ids = [*ids, *marks["\n"], *begun, *marks[mark2]]
                    out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def forget(self) -> None:
        self.numbers, self.chars, self.used = _Numbers(), 0, 0
        self.starts: dict[str, list[int]] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.alone, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)

    def thin_out(self) -> None:
        """Forgets what was met once, is long, or is not among the half that is met most."""
        keys = list(self.numbers)
        sizes = np.fromiter((len(k) if isinstance(k, str) else len(k[0]) for k in keys), np.int64, len(keys))
        keep = np.flatnonzero((self.uses > 1) & (sizes < 100))
        most = self.memory * MOST_PIECES // 2
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        length, start = self.length[keep], self.start[keep]
        ends = np.cumsum(length)
        total = int(length.sum())
        flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(total)]
        alone, uses = self.alone[keep], self.uses[keep] // 2
        self.forget()
        for i in keep.tolist():
            self.numbers[keys[i]]
        self.numbers.new = []
        self.start, self.length, self.alone, self.uses = ends - length, length, alone, uses
        self.flat, self.used, self.chars = flat, total, int(sizes[keep].sum())

    def learn(self) -> None:
        """Encodes the new pieces and notes which may stand alone: those without white space at an end."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        # Many small lists and no cycle are made here: looking for cycles again and again would only take time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            self.add(new)
        finally:
            if collecting:
                gc.enable()

    def add(self, new: list[str | tuple[str]]) -> None:
        # A text's first piece is a tuple; any other follows a space.
        bare = [p if isinstance(p, str) else p[0] for p in new]
        alone = [
            bool(q) and not (q[0].isspace() or q[-1].isspace()) if isinstance(p, str) else not q[-1:].isspace()
            for p, q in zip(new, bare, strict=True)
        ]
        ready = [" " + p if isinstance(p, str) else p[0] for p in new]
        ids = self.encoded(ready)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat), 1 << 16), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.alone = np.concatenate([self.alone, np.array(alone, bool)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.used += total
        self.chars += sum(map(len, bare))

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has."""
        if len(self.numbers) > self.memory * MOST_PIECES or self.chars > self.memory * MOST_CHARS:
            self.thin_out()
        get = self.numbers.__getitem__

        def look_up(parts: list[str]) -> list[int]:
            return [get((parts[0],)), *map(get, parts[1:])]

        def joined() -> tuple[np.ndarray, np.ndarray]:
            self.learn()
            counts = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum())), counts

        each = [look_up(t.split(" ")) for t in texts]
        numbers, counts = joined()
        if not self.alone[numbers].all():
            for i in np.unique(np.repeat(np.arange(len(texts)), counts)[~self.alone[numbers]]).tolist():
                each[i] = look_up(SPLIT.split(texts[i]))
            numbers, counts = joined()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers, counts

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        for group in grouped(texts):
            numbers, counts = self.numbered(group)
            length = self.length[numbers]
            ends = np.cumsum(length)
            where = np.repeat(self.start[numbers] - (ends - length), length) + np.arange(int(length.sum()))
            flat = self.flat[where]
            ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield flat[a:b]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for group in grouped(texts):
            numbers, counts = self.numbered(group)
            ends = np.concatenate([[0], np.cumsum(self.length[numbers])])
            out.append(np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))
        return np.concatenate(out)


def grouped(texts: list[str | None]) -> Iterator[list[str]]:
    group, chars = [], 0
    for text in texts:
        group.append(text or "")
        chars += len(group[-1])
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group
