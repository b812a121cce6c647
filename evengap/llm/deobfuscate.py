"""Noisy-channel restoration of disguised words: a character language model and Viterbi decoding.

The model counts character trigrams of all documents. A disguised word is a lattice: each character may stand for itself,
for the letters it imitates, or for nothing (a separator, a repetition). The best path under model and channel wins.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.llm.wordids import forget_all, slices

#: Letters that digits and signs imitate.
IMITATED = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()) + "œ"
SIZE = 64
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Log costs of the channel.
IMITATE, DROP_SIGN, DROP_REPEAT, SIGN_IS_LETTER = -1.5, -1.5, -1.0, -8.0
#: A character and its repetitions; three that stand alone behind each other.
TWICE = re.compile(r"((.)\2+)")
ALONE = re.compile(r"(?<!\S)\S\s+\S\s+\S(?!\S)")
#: Longest word that is read as one, and the windows of longer input.
OVERLAP, WINDOW = 48, 2048


def _table() -> np.ndarray:
    table = np.zeros(0x180, np.int64)
    for c in range(0x180):
        table[c] = CODE.get(chr(c).lower(), 0)
    return table


TABLE = _table()


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of three successive characters, all other signs being one class."""
    text = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(text < len(TABLE), TABLE[np.minimum(text, len(TABLE) - 1)], 0)
    return np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)


def count_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) over every document; at most 64^3 rows however large the table."""
    def counted(batches):
        forget_all()
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in slices([len(t) for t in texts], 500_000):
                total += trigrams(texts[a:b])
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Log probabilities of a character after two others, smoothed by those after one and by itself."""
    n3 = np.zeros(SIZE**3)
    for code, n in counts:
        n3[code] = n
    n3 = n3.reshape(SIZE, SIZE, SIZE)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 0.5) / (n1 + 0.5).sum()
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    p3 = (n3 + 20 * p2) / (n3.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


def spelled(out) -> str:
    """The letters of a path, which is a chain of its last letter and the path before."""
    letters = []
    while out is not None:
        out, x = out
        letters.append(x)
    return "".join(reversed(letters))


def restore(word: str, model: np.ndarray, drop: float = DROP_SIGN) -> str:
    """The likeliest plain word behind a lower-case one, of any length; `drop` is the cost of leaving out a sign."""
    paths: dict = {(0, 0): (0.0, None)}
    before = ""
    for c in word:
        step: dict = {}
        outs = [(c, CODE[c], 0.0)] if c in CODE else []
        outs += [(x, CODE[x], IMITATE) for x in IMITATED.get(c, "")]
        skip = DROP_REPEAT if c == before else drop if c not in CODE else None
        for state, (score, out) in paths.items():
            if skip is not None and (state not in step or step[state][0] < score + skip):
                step[state] = (score + skip, out)
            a, b = state
            row = model[a][b]
            for x, code, cost in outs:
                new, to = score + cost + row[code], (b, code)
                if to not in step or step[to][0] < new:
                    step[to] = (new, (out, x))
        paths, before = step or paths, c
    return spelled(max(((score + model[a][b][0], out) for (a, b), (score, out) in paths.items()), key=lambda x: x[0])[1])


def segments(word: str, model: np.ndarray, anywhere: bool = False) -> set[str]:
    """Words on the likeliest path that may also end at signs or, if `anywhere`, behind any letter.

    Long input is read in windows that overlap by more than a word, so time and memory grow with its length only.
    """
    found: set[str] = set()
    for at in range(0, max(1, len(word) - OVERLAP), WINDOW - OVERLAP):
        paths: dict = {(0, 0): (0.0, None)}
        before = ""
        for c in word[at:at + WINDOW]:
            step: dict = {}

            def reach(state: tuple, score: float, out) -> None:
                if step.get(state, (-math.inf,))[0] < score:
                    step[state] = (score, out)

            outs = [(c, 0.0)] if c in CODE else []
            outs += [(x, IMITATE) for x in IMITATED.get(c, "")]
            skip = DROP_REPEAT if c == before else DROP_SIGN if c not in CODE else None
            for (a, b), (score, out) in paths.items():
                if skip is not None:
                    reach((a, b), score + skip, out)
                if c not in CODE:  # the sign ends a word, or follows an end
                    reach((b, 0) if b else (a, b), score + model[a][b][0] if b else score, (out, " ") if b else out)
                for x, cost in outs:
                    reach((b, CODE[x]), score + cost + model[a][b][CODE[x]], (out, x))
            if anywhere:
                for (a, b), (score, out) in list(step.items()):
                    if b:
                        reach((b, 0), score + model[a][b][0], (out, " "))
            paths, before = step or paths, c
        _, out = max(((score + (model[a][b][0] if b else 0.0), out) for (a, b), (score, out) in paths.items()), key=lambda x: x[0])
        found.update(spelled(out).split())
    return found


class Restorer:
    """Restored words of texts."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()  # single numbers are read faster from lists

    def word(self, token: str) -> tuple[str, ...]:
        """Readings of one token: the letters it has, and what it may disguise."""
        low = token.lower()
        core = low.strip(".,;:!?%*#&\"'()[]{}|-_/\\<>=~^`")
        if core.isalpha():
            twice = [x for x, _ in TWICE.findall(core)]
            if not twice:
                return (core,)
            if len(twice) == 1 and len(twice[0]) == 2:
                return self.doubled(core)
            if max(map(len, twice)) == 2:
                return tuple(dict.fromkeys(x for x in (core, restore(core, self.model)) if x))
        plain = "".join(c for c in core if c.isalpha())
        found = [plain, *(restore(x, self.model) for x in {core, low}), restore(core, self.model, SIGN_IS_LETTER)]
        if any(c not in CODE for c in core):  # its runs of letters, and the words its signs hide or part
            found += "".join(c if c.isalpha() else " " for c in core).split()
            found += sorted(segments(core, self.model))
        return tuple(dict.fromkeys(x for x in found if x))

    def doubled(self, word: str) -> tuple[str, ...]:
        """As `restore` for a word of letters with one doubled: only the trigrams around it differ."""
        at = TWICE.search(word).start()
        b, c, d = (CODE.get(x) for x in (word[at - 1] if at else "", word[at], word[at + 2:at + 3]))
        b, d = b if at else 0, d if len(word) > at + 2 else 0
        if None in (b, c, d):
            return tuple(dict.fromkeys(x for x in (word, restore(word, self.model)) if x))
        once = self.model[b][c][d] + DROP_REPEAT
        return (word, word[:at] + word[at + 1:]) if once > self.model[b][c][c] + self.model[c][c][d] else (word,)

    def words(self, text: str) -> set[str]:
        tokens = text.split()
        return {w for t in set(tokens) for w in self.word(t)} | self.spaced(text)

    def spaced(self, text: str) -> set[str]:
        """Words whose letters stand alone, as in "w o r d"."""
        if not ALONE.search(text):
            return set()
        tokens = text.split()
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        edge = np.diff(np.concatenate([[0], single, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out: set[str] = set()
        for a, b in zip(begin, end):
            if b - a < 3:
                continue
            run = "".join(tokens[a:b]).lower()
            out |= segments(run, self.model, anywhere=True)
            out |= {restore(run[skip:], self.model) for skip in (0, 1)}  # "a w o r d" too
        return out - {""}
