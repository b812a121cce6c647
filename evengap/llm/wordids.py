"""Token ids of whole texts by a file of the tokenizers library, with the ids of each word kept between texts.

A text may be cut before a space, or around a newline, that stands alone between other characters: neither file's rules
look across such a cut. The library encodes every piece it has not met; what has been met is looked up. A text that
can't be cut safely is encoded whole.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT: dict[tuple, "WordIds"] = {}
UNSAFE = -2
#: What a file may do to a text before it is cut, none of which changes lower-case Latin-1 letters or spaces between them.
IDLE = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
LETTERS = "[\\p{L}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def encoder(path: str, spaced: bool) -> "WordIds":
    """One encoder for a file and worker, kept between its tasks; whatever else was kept is freed."""
    if (path, spaced) not in KEPT:
        KEPT.clear()
        KEPT[path, spaced] = WordIds(path, spaced)
    return KEPT[path, spaced]


class WordIds:
    """spaced: a word's leading space is part of it (byte-level files); else white space only separates."""

    def __init__(self, path: str, spaced: bool, most: int = 300_000):
        from tokenizers import Tokenizer

        self.library, self.spaced, self.most = Tokenizer.from_file(path), spaced, most
        self.library.encode_special_tokens = True
        signs = {x: self.whole(x) for x in ".,"}
        vocabulary = self.library.get_vocab()
        self.ends = self.begins = None
        if spaced and any(x.startswith("Ġ") for x in vocabulary):  # as byte-level files write a space
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        if not spaced and any(x.endswith("</w>") for x in vocabulary):
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.folds = not spaced and self.whole("Ab ÀÖØÞ").tolist() == self.whole("ab àöøþ").tolist()  # the file ignores case
        self.plain = self.library if self.ends is None else self.for_letters() or self.library
        self.signs = {x: int(ids[0]) for x, ids in signs.items() if len(ids) == 1}
        self.age()
        self.age()

    def age(self) -> None:
        """Begin a new generation; of the last one, pieces that are met again move over, the one before is dropped."""
        pa.default_memory_pool().release_unused()
        self.older = (self.known, self.start, self.length, self.pool) if hasattr(self, "known") else None
        self.known: dict[str, int] = {"": 0}
        self.start, self.length, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool = np.zeros(1 << 18, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def for_letters(self):
        """The library's model with no more before it than lower-case letters between spaces need, if the file allows it."""
        from tokenizers import Tokenizer, pre_tokenizers

        rules = json.loads(self.library.to_str())
        before, cut = rules["normalizer"] or {}, (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if any(x not in IDLE for x in before.get("normalizers", [before] if before else [])) or len(cut) != 2:
            return None
        runs, inner = cut
        if (runs["type"], runs.get("invert"), runs.get("behavior")) != ("Split", True, "Removed"):
            return None
        # other rules before the one of letters all begin with a sign
        ahead, found, _ = runs["pattern"].get("Regex", "").partition(LETTERS)
        if not found or any(x[0] != "'" for x in ahead.split("|") if x) or inner != BYTES:
            return None
        plain = Tokenizer(self.library.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def ready(self, text: str) -> str | None:
        """A text as it is cut, or nothing if it can't be cut safely."""
        if not self.spaced:
            return text.lower() if self.folds and latin(text) else text
        if "\0" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        return text

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or nothing if it can't be cut safely."""
        text = self.ready(text)
        if text is None:
            return None
        _, place, words = self.cut([text])
        return [words[i] for i in place]

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The number of pieces of each text, the place of every piece among the different ones, and these."""
        cut = pa.array(texts, pa.large_string())
        if self.spaced:
            mark, cut = "\0", pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        else:
            mark, cut = " ", pc.replace_substring(cut, "\n", " ")
        cut = pc.split_pattern(cut, mark)
        found = cut.flatten().dictionary_encode()
        # no piece holds the mark, and one string is cut faster than many are made
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary),
                               pa.scalar(mark, pa.large_string()))
        return (pc.list_value_length(cut).to_numpy(), found.indices.to_numpy(),
                words[0].as_py().split(mark) if len(found.dictionary) else [])

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        # a piece's number is its place in the dictionary, where unsafe pieces have places too
        first, n = len(self.known), len(words)
        while first + n > len(self.start):
            self.start, self.length = np.concatenate([self.start] * 2), np.concatenate([self.length] * 2)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.pool[self.used:self.used + len(ids)] = ids
        self.length[first:first + n] = counts
        self.start[first:first + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + n)))

    def again(self, words: list[str]) -> list[str]:
        """Take over pieces of the generation before; the others are returned."""
        known, start, length, pool = self.older
        at = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.known.update((words[i], UNSAFE) for i in np.flatnonzero(at == UNSAFE))
        met = np.flatnonzero(at >= 0)
        if len(met):
            counts = length[at[met]]
            inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            self._keep([words[i] for i in met], pool[np.repeat(start[at[met]], counts) + inside], counts)
        return [words[i] for i in np.flatnonzero(at == -1)]

    def learn(self, words: list[str]) -> None:
        """Keep pieces that were not met before.

        A full stop or comma behind a letter is a word of its own to both files, so what is before it is encoded once,
        and the sign is added.
        """
        signed = [w for w in words if w[-1:] in self.signs and w[-2:-1].lower().isalpha()]
        if not signed:
            self.encode(words)
            return
        apart = set(signed)
        plain = dict.fromkeys(w for w in words if w not in apart)
        bases = [w[:-1] for w in signed]
        more = self.again([b for b in dict.fromkeys(bases) if b not in self.known and b not in plain])
        self.encode([*plain, *more])
        at = np.fromiter(map(self.known.__getitem__, bases), np.int64, len(bases))
        self.known.update((signed[i], UNSAFE) for i in np.flatnonzero(at == UNSAFE))
        safe = np.flatnonzero(at >= 0)
        own = self.length[at[safe]]
        ends = np.cumsum(own + 1)
        ids = np.empty(int(own.sum()) + len(safe), np.uint32)
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        ids[np.repeat(ends - own - 1, own) + inside] = self.pool[np.repeat(self.start[at[safe]], own) + inside]
        ids[ends - 1] = [self.signs[signed[i][-1]] for i in safe]
        self._keep([signed[i] for i in safe], ids, own + 1)

    def encode(self, words: list[str]) -> None:
        """Encode pieces by the library.

        A piece of letters is one word to a file of word ends, so its ids end at the id that ends a word. The ids of other
        pieces are told by their offsets.
        """
        if self.ends is not None:
            one = np.fromiter(map(str.isalpha, words), bool, len(words))
            letters, words = list(itertools.compress(words, one)), list(itertools.compress(words, ~one))
            for i in range(0, len(letters), 500):
                part = letters[i:i + 500]
                text = " ".join(part)
                library = self.plain if latin(text) and text.lower() == text else self.library
                if library is self.library and not text.isascii():
                    words += [w for w in part if not w.lower().isalpha()]
                    part = [w for w in part if w.lower().isalpha()]
                    text = " ".join(part)
                ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids])
                if len(ends) == len(part):
                    self._keep(part, ids, np.diff(ends, prepend=-1))
                else:
                    words += part
        joint, single = words, []
        if self.spaced:
            odd = [w for w in words if w[0] != " " or w[-1].isspace() or w[1].isspace()]
            if odd:
                apart = set(odd)
                joint = [w for w in words if w not in apart]
            for w in odd:
                core = w[1:] if w[0] == " " else w
                if w not in ("\n", " ") and (core[0].isspace() or core[-1].isspace()):
                    self.known[w] = UNSAFE
                else:
                    single.append(w)
        for i in range(0, len(joint), 2000):
            part = joint[i:i + 2000]
            text = ("" if self.spaced else " ").join(part)
            if self.begins is not None and text.count(" ") == len(part):
                ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                first = np.flatnonzero(self.begins[ids])
                if len(first) == len(part) and first[0] == 0:
                    self._keep(part, ids, np.diff(first, append=len(ids)))
                    continue
            got = self.library.encode(text, add_special_tokens=False)
            size = np.fromiter(map(len, part), np.int64, len(part)) + (not self.spaced)
            begins = np.cumsum(size) - size
            at = np.array([o[0] for o in got.offsets], np.int64)
            counts = np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(part))
            self._keep(part, np.array(got.ids, np.uint32), counts)
        for i in range(0, len(single), 2000):
            part = single[i:i + 2000]
            got = [x.ids for x in self.library.encode_batch(part, add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32)
            self._keep(part, ids, np.fromiter(map(len, got), np.int64, len(got)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and the number of ids of each text."""
        if len(self.known) > self.most:
            self.age()
        ready = [self.ready(t) for t in texts]
        sizes, place, words = self.cut(["" if t is None else t for t in ready])
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at == -1)
        if len(missing):
            new = [words[i] for i in missing]
            self.learn(self.again(new))
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        owner = np.repeat(np.arange(len(texts)), sizes)
        odd = {i for i, t in enumerate(ready) if t is None}
        unsafe = at == UNSAFE
        if unsafe.any():
            odd |= set(owner[unsafe[place]].tolist())
            at[unsafe] = 0
        length = self.length[at][place]
        total = int(length.sum())
        begin = self.start[at][place] - np.cumsum(length) + length
        ids = self.pool[np.repeat(begin, length) + np.arange(total)]
        counts = np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)
        if odd:
            ends = np.cumsum(counts)
            parts = [self.whole(t) if i in odd else ids[ends[i] - counts[i]:ends[i]] for i, t in enumerate(texts)]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, counts


def latin(text: str) -> bool:
    """Whether a text holds Latin-1 only, whose letters all have the one lower case that the library gives them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def forget_all() -> None:
    """Free what encoders keep in this worker: other operators call it, since workers are used again."""
    KEPT.clear()


def slices(sizes: list[int], most: int):
    """Ranges of neighbours whose sizes add up to `most` at most, or single ones beyond it."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
