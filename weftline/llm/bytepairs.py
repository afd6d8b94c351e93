"""Byte-level BPE of whole texts, for operators 2 and 4.

Words, each with the one space before it, are encoded by the tokenizers library once
each and remembered, up to a bound. No pre-token of this family of tokenizers goes
over the start of a space that has a character other than white space behind it, so
words don't depend on their neighbours. Neither do the lines within a word, where one
line feed parts them, nor the marks that end a word of letters: what is left of a new
word without these has often been seen before. Texts with a special token's text,
where that counts as one, and texts with other spacing go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space at an end of a text, or a space before another white space: words around it aren't on their own.
LOOSE = r"^ | $| [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text whose words are looked up together, and words that go to the library in one call.
PORTION, JOINED = 1 << 22, 4096
#: Before this character all agree on what is a letter, whatever their version of Unicode.
LETTERS_TO = "\u0530"
#: Characters that are a pre-token of their own after letters; an apostrophe can belong to the letters behind it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, cut where their bytes go over PORTION."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PORTION, "right")))
        yield texts.slice(at, to - at)
        at = to


class _Known:
    """Words with their places in a pool: an open table of hashes in arrays, at a quarter of the memory of a dict.

    A hash only proposes a place; the word that stands there is compared.
    """

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.hashes, self.places = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def _hashed(words: list[str]) -> np.ndarray:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        return np.where(h == 0, np.uint64(1), h)  # 0 is an empty slot

    def find(self, words: list[str], same: pa.Array | None = None) -> np.ndarray:
        """Each word's place, or -1. same: the words as an array, if there is one."""
        h = self._hashed(words)
        mask = np.uint64(len(self.hashes) - 1)
        place, slot, todo = np.full(len(words), -1, np.int64), h & mask, np.arange(len(words))
        while len(todo):
            at = slot[todo]
            have = self.hashes[at]
            hit = have == h[todo]
            place[todo[hit]] = self.places[at[hit]]
            todo = todo[~hit & (have != 0)]
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
        met = np.flatnonzero(place >= 0)
        if len(met):
            same = pa.array(words, pa.string()) if same is None else same
            equal = pc.equal(self.words.take(pa.array(place[met])), same.take(pa.array(met))).to_numpy(zero_copy_only=False)
            place[met[~equal]] = -1
        return place

    def add(self, words: list[str]) -> None:
        """Words that aren't known take the next places."""
        n = len(self.words) + len(words)
        if 2 * n > len(self.hashes):
            used = np.flatnonzero(self.hashes)
            h, places = self.hashes[used], self.places[used]
            size = 1 << (4 * n - 1).bit_length()
            self.hashes, self.places = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(h, places)
        self._put(self._hashed(words), np.arange(len(self.words), n, dtype=np.int32))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        mask = np.uint64(len(self.hashes) - 1)
        slot, todo = h & mask, np.arange(len(h))
        while len(todo):
            at = slot[todo]
            free = np.flatnonzero(self.hashes[at] == 0)
            _, one = np.unique(at[free], return_index=True)  # one word for each free slot
            won = free[one]
            self.hashes[at[won]], self.places[at[won]] = h[todo[won]], places[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + np.uint64(1)) & mask


class _Pool:
    """Ids of many words in one array; what comes after `kept` is overwritten by the next portion."""

    def __init__(self):
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.kept, self.words = 0, 0  # ids and words that stay

    def add(self, raw: list[bytes], keep: int = 0) -> np.ndarray:
        """Puts words' ids behind those that stay, the first `keep` of them to stay too; their places."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
        ids = np.frombuffer(b"".join(raw), "<u4")
        self.ids = _room(self.ids, self.kept + len(ids))
        self.start, self.size = _room(self.start, self.words + len(raw)), _room(self.size, self.words + len(raw))
        self.ids[self.kept : self.kept + len(ids)] = ids
        places = np.arange(self.words, self.words + len(raw))
        self.start[places] = self.kept + np.cumsum(sizes) - sizes
        self.size[places] = sizes
        self.kept, self.words = self.kept + int(sizes[:keep].sum()), self.words + keep
        return places

    def bytes(self, places: np.ndarray) -> list[bytes]:
        start, size = self.start[places].astype(np.int64), self.size[places]
        raw = memoryview(self.ids).cast("B")
        return [bytes(raw[a:b]) for a, b in zip((4 * start).tolist(), (4 * (start + size)).tolist(), strict=True)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])


def _core(word: str) -> tuple[str, str]:
    """A word without the marks at its end, and these, if letters are all that is before them; else the word."""
    core = word.rstrip(MARKS)
    return (core, word[len(core) :]) if core.isalpha() and max(core) < LETTERS_TO else (word, "")


class BytePairs:
    def __init__(self, tokenizer_json: str, specials_are_text: bool = False, memo: int = 3 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.specials = () if specials_are_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: Words side by side could make a special token, so each goes to the library on its own.
        self.alone = any(c.isspace() for s in self.specials for c in s)
        self.known = _Known()  # a word's place in the pool, by the word without the space before it
        self.pool = _Pool()
        self.lines: dict[str, bytes] = {}  # by what stands after a line feed
        self.marks: dict[str, bytes] = {}  # by the marks after a word of letters
        self.memo = memo
        self._size = None

    @property
    def byte_sizes(self) -> np.ndarray:
        """How many bytes of text each id stands for."""
        if self._size is None:
            special = {t.content: len(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()}
            vocab = self.tokenizer.get_vocab()
            self._size = np.zeros(max(vocab.values()) + 1, np.int64)
            for t, i in vocab.items():
                self._size[i] = special.get(t, len(t))  # a byte is one character in the vocabulary's spelling
        return self._size

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; no special tokens are added."""
        out = []
        for ids, ends in self.encode(pa.array(texts, pa.string())):
            raw, at = ids.tobytes(), 0
            for e in (4 * ends).tolist():
                out.append(raw[at:e])
                at = e
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Portions of the texts, in order: all their ids, and where each text's ids end."""
        for some in portions(texts):
            whole = pc.match_substring_regex(some, LOOSE)
            for x in self.specials:
                whole = pc.or_(whole, pc.match_substring(some, x))
            split = pc.split_pattern(pc.if_else(whole, "", some), " ")
            ends = np.diff(split.offsets.to_numpy()).cumsum()
            first = np.concatenate([[0], ends[:-1]])
            coded = split.flatten().dictionary_encode()
            words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            heads = self._ids(pc.if_else(whole, some, split.flatten().take(pa.array(first))).to_pylist())
            rest = np.ones(len(codes), bool)
            rest[first] = False
            used = np.zeros(len(words), bool)
            used[codes[rest]] = True  # a word that only starts texts isn't looked up
            place = self.known.find(words, coded.dictionary)
            missing = np.flatnonzero(used & (place < 0))
            asked = [words[i] for i in missing.tolist()]
            new = self._words(asked) if asked else {}
            keep = min(len(new), max(0, self.memo - len(self.known)))
            places = self.pool.add([*new.values(), *heads], keep)
            found = dict(zip(new, places.tolist(), strict=False))
            place[missing] = np.fromiter(map(found.__getitem__, asked), np.int64, len(asked))
            if keep:
                self.known.add(list(islice(new, keep)))
            at = place[codes]
            at[first] = places[len(new) :]
            size = self.pool.size[at]
            upto = np.cumsum(size, dtype=np.int64)
            if len(upto) and upto[-1] < 1 << 31:
                upto = upto.astype(np.int32)
            where = np.repeat(self.pool.start[at] - upto + size, size)
            where += np.arange(len(where), dtype=where.dtype)
            yield self.pool.ids[where], upto[ends - 1]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't known, each with a space before it, and of what these are made of."""
        whole, made = [], []
        lines_of: list[tuple[str, list[str]]] = []
        for w in words:
            if w.isalpha():
                whole.append(w)
            elif "\n" in w and (lines := w.split("\n")) == w.split():  # line feeds that are alone
                lines_of.append((w, lines))
            else:
                core, mark = _core(w)
                if mark:
                    made.append((w, core, mark))
                else:
                    whole.append(w)
        firsts, later, new_marks = [], set(), {x for _, _, x in made}
        for w, lines in lines_of:
            firsts.append(lines[0])
            later.update(lines[1:])
        cores, bare = set(), set()
        heads = [(x, *_core(x)) for x in {*firsts}]
        for _, core, mark in heads:
            cores.add(core)
            if mark:
                new_marks.add(mark)
        ends = [(x, *_core(x)) for x in later.difference(self.lines)]
        for _, core, mark in ends:
            bare.add(core)
            if mark:
                new_marks.add(mark)
        cores.update([c for _, c, _ in made])
        cores = list(cores.difference(whole))
        at = self.known.find(cores)
        have = dict(zip([cores[i] for i in np.flatnonzero(at >= 0).tolist()], self.pool.bytes(at[at >= 0]), strict=True))
        out = self._joined([*whole, *[c for c in cores if c not in have]], " ")
        marks = [x for x in new_marks if x not in self.marks]
        marks = dict(zip(marks, self._ids(marks), strict=True)) | self.marks
        lines = self._joined(list(bare.difference(self.lines)), "\n")
        for w, core, mark in made:
            out[w] = (out.get(core) or have[core]) + marks[mark]
        for line, core, mark in ends:
            if mark:
                lines[line] = (lines.get(core) or self.lines[core]) + marks[mark]
        head_of = {line: (out.get(core) or have[core]) + (marks[mark] if mark else b"") for line, core, mark in heads}
        for w, (first, *rest) in lines_of:
            out[w] = head_of[first] + b"".join([lines.get(x) or self.lines[x] for x in rest])
        for memo, most, new in ((self.lines, self.memo >> 2, lines), (self.marks, self.memo >> 4, marks)):
            room = most - len(memo)
            memo.update(new if len(new) <= room else islice(new.items(), max(0, room)))
        return out

    def _joined(self, words: list[str], before: str) -> dict[str, bytes]:
        """Each word's ids with the space or line feed before it. Many words are one text for the library, cut again by the bytes that ids stand for."""
        if self.alone:
            return dict(zip(words, self._ids([before + w for w in words]), strict=True))
        out = {}
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            raw = self._ids([before + before.join(some)])[0]
            ends = np.cumsum(self.byte_sizes[np.frombuffer(raw, "<u4")])
            borders = 4 * (np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in some])) + 1)
            last = 0
            for w, e in zip(some, borders.tolist(), strict=True):
                out[w] = raw[last:e]
                last = e
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]


_made: dict[tuple, BytePairs] = {}


def byte_pairs(tokenizer_json: str, specials_are_text: bool = False) -> BytePairs:
    """One encoder for each Python worker, so that later tasks find its memory warm."""
    import gc
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(tokenizer_json), specials_are_text
    if key not in _made:
        gc.set_threshold(100_000)
        _made.clear()
        _made[key] = BytePairs(tokenizer_json, specials_are_text)
    return _made[key]


def forget() -> None:
    """Lets go of the worker's encoder, for tasks that come after all encoding."""
    _made.clear()
