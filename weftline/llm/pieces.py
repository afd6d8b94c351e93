"""Operator 1: SentencePiece encoding and decoding.

A merge-type model gives one right segmentation: the one that greedy merging by
score ends in. It is also the only sequence of pieces in which every two
neighbours, merged anew from their characters, come out as those same two
pieces. So the encoder walks the text with the longest piece at each place
(found by an Aho-Corasick automaton), checks that piece against its left
neighbour, tries ever shorter pieces, and steps back when none fits. A bit for
each place tells where no valid rest was found, so no place is tried twice.

Pieces made only of the space mark share one score below all others in such
models, so runs of spaces are merged after the rest, from the left.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 0, 1, 2, 3


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; the model file is read on the driver alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else NORMAL
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class _Memo(dict):
    """Remembers at most `most` results of a function; what comes later is worked out each time."""

    def __init__(self, f, most: int):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        out = self.f(key)
        if len(self) < self.most:
            self[key] = out
        return out


class PieceCodec:
    """Encoder and decoder of one model. Null text counts as empty; empty text has no pieces."""

    def __init__(self, model: list[tuple[str, float, int]], memo: int = 1 << 18):
        self.ids = {p: i for i, (p, _, k) in enumerate(model) if k == NORMAL}
        self.score = {p: s for p, s, k in model if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(model) if k == UNKNOWN)
        self.end = next((i for i, (p, _, k) in enumerate(model) if k == CONTROL and p == "</s>"), None)
        self.chars = {p for p in self.ids if len(p) == 1}
        for p in self.ids:
            if MARK in p[1:] and set(p) != {MARK} and not (p[0] == MARK and MARK not in p[1:]):
                raise ValueError(f"piece {p!r} goes over a word's start")
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: i for i, p in enumerate(order)}  # the earlier a piece is merged, the lower
        self.age = self.rank | dict.fromkeys(self.chars, -1)
        self.halves: dict[str, tuple[str, str]] = {}  # what a piece was last merged from
        self.tree = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or MARK not in p[1:] and self.merged(p, self.halves) == [p]:
                self.tree.add_word(p, (len(p) - 1, p))
        self.tree.make_automaton()
        for _, p in list(self.tree.values()):  # a place's longest piece tells all that start there
            self.tree.add_word(p, (len(p) - 1, tuple((self.ids[p[:n]], n) for n in range(len(p), 0, -1) if p[:n] in self.tree)))
        self.tree.make_automaton()
        name = [p for p, _, _ in model]
        self.fits = _Memo(lambda pair: self.remerge(name[pair >> 32], name[pair & 0xFFFFFFFF]), 1 << 20)
        self.word = _Memo(lambda w: tuple(self.encode_word(MARK + w)), memo)
        self.spelled = _Memo(self._spell, memo)
        self.spaces = _Memo(lambda n: tuple(self.ids[p] for p in self.merged_run(n)), 4096)
        self.shown = [str(i) for i in range(len(model))]
        # a byte below 0x80 is a character; the others wait as lone surrogates until their run is whole
        self.text = [p if k == NORMAL else " ⁇ " if k == UNKNOWN else "" if k == CONTROL else chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else chr(0xDC00 + int(p[3:5], 16)) for p, _, k in model]

    def merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Greedy merging from single characters: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if halves is not None:
                halves[parts[at] + parts[at + 1]] = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def remerge(self, left: str, right: str) -> bool:
        """Whether two pieces side by side, merged anew, come out as the same two.

        Undoes the merges next to the border, latest first. The pair is wrong if the
        parts at the border could have merged before the merge that was undone last.
        """
        before = len(self.rank)
        while True:
            joined = self.rank.get(left + right)
            if joined is not None and joined < before:
                return False
            a, b = self.age[left], self.age[right]
            if a > b:
                before, left = a, self.halves[left][1]
            elif b >= 0:
                before, right = b + 1, self.halves[right][0]
            else:
                return True

    def merged_run(self, n: int) -> list[str]:
        """merged() of n marks, for any n: marks pair from the left, round by round, as their scores are equal.

        Equal scores are taken leftmost first, so a piece keeps growing at the left
        before the next one starts; only that one piece has to be looked at.
        """
        out: list[str] = []
        parts = [MARK] * min(n, 64)
        left = n - len(parts)
        while parts:
            parts = self.merged("".join(parts))
            if not left:
                return out + parts
            out, parts = out + parts[:1], parts[1:]
            take = min(left, 64 - sum(map(len, parts)))
            parts, left = [MARK] * (sum(map(len, parts)) + take), left - take
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch that has the space mark at its start at most. Characters without a piece are bytes."""
        if self.chars.issuperset(word):
            return self.backtrack(word)
        out: list[int] = []
        for known, odd in self._stretches(word):
            out += self.backtrack(known) if known else []
            for b in odd.encode("utf-8"):
                out.append(self.bytes.get(b, self.unknown))
        return out

    def _stretches(self, word: str) -> Iterator[tuple[str, str]]:
        start = 0
        for i, c in enumerate(word):
            if c not in self.chars:
                yield word[start:i], c
                start = i + 1
        yield word[start:], ""

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch whose characters are all pieces."""
        n, fits = len(text), self.fits
        longest: list[tuple[tuple[int, int], ...]] = [()] * n
        for last, (before, pieces) in self.tree.iter(text):
            longest[last - before] = pieces
        dead = 0  # bit i: no valid rest starts at place i
        out: list[int] = []
        left, pos = -1, 0
        rest = iter(longest[0])
        back = []  # what is still untried at each earlier place, and that place
        while pos < n:
            for piece, size in rest:
                if not dead >> pos + size & 1 and (left < 0 or fits[left << 32 | piece]):
                    back.append((rest, pos))
                    out.append(piece)
                    left = piece
                    pos += size
                    rest = iter(longest[pos]) if pos < n else rest
                    break
            else:
                dead |= 1 << pos
                if not out:
                    raise ValueError(f"no valid pieces for {text[:40]!r}")
                out.pop()
                rest, pos = back.pop()
                left = out[-1] if out else -1
        return out

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        if not text:
            return [self.end] if end else []
        words = text.replace(" ", MARK).split(MARK)
        if "" in words:
            out: list[int] = []
            run, mark = 0, self.ids[MARK]
            for w in words:
                run += 1
                if w:
                    got = self.word[w]
                    if got[0] == mark:
                        out += self.spaces[run]
                        out += got[1:]
                    else:
                        out += self.spaces[run - 1] if run > 1 else ()
                        out += got
                    run = 0
            out += self.spaces[run] if run else ()
        else:
            out = list(chain.from_iterable(map(self.word.__getitem__, words)))
        if end:
            out.append(self.end)
        return out

    def _spell(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(MARK + word)
        return " ".join(map(self.shown.__getitem__, ids)), self._joined(ids)

    def spell(self, text: str | None) -> tuple[str, str]:
        """encode() with the end id as text, ids joined by one space, and decode() of those ids.

        A word's ids and what these decode to don't depend on the words around, unless
        spaces follow each other, so both are remembered by word.
        """
        words = text.replace(" ", MARK).split(MARK) if text else [""]
        if "" in words:
            ids = self.encode(text)
            return " ".join(map(self.shown.__getitem__, ids)), self.decode(ids)
        got = list(map(self.spelled.__getitem__, words))
        return f"{' '.join([x for x, _ in got])} {self.end}", "".join([x for _, x in got])[1:]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces; the one space that encoding puts in front goes. Bytes that are no UTF-8 show as U+FFFD each."""
        out = self._joined(ids)
        first = next((i for i in ids if self.text[i]), None)
        return out[1:] if first is not None and self.text[first][0] == MARK else out

    def _joined(self, ids: list[int]) -> str:
        out = "".join(map(self.text.__getitem__, ids)).replace(MARK, " ")
        try:
            out.encode("utf-8")
        except UnicodeEncodeError:
            out = re.sub("[\udc80-\udcff]+", lambda m: _utf8(bytes(ord(c) - 0xDC00 for c in m[0])), out)
        return out


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def _codec(shared) -> PieceCodec:
    """One codec for each Python worker and model, so that later tasks find it warm."""
    key = hash((len(shared.value), *shared.value[-1], *shared.value[-2]))
    if key not in _codecs:
        _codecs.clear()
        gc.set_threshold(100_000)  # the memo is large and has no cycles
        _codecs[key] = PieceCodec(shared.value)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's pieces, and what they decode to.

    Returns the id, n_tokens, ids_sha256, decoded_sha256 and round_trip (the decoded
    text is the text); with keep_ids also ids, an array of int. One row for each row of
    docs: repeated rows stay repeated, a null id stays null, null text counts as empty
    and has the end id alone. Other columns of docs aren't looked at. No shuffle.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    ids_kind = ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        sha = hashlib.sha256
        for batch in (some.slice(at, 256) for some in batches for at in range(0, some.num_rows, 256)):
            n, a, b, same, all_ids = [], [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                shown, back = codec.spell(text)
                n.append(shown.count(" ") + 1)
                a.append(sha(shown.encode("ascii")).hexdigest())
                b.append(sha(back.encode("utf-8")).hexdigest())
                same.append(back == text)
                if keep_ids:
                    all_ids.append(np.array(shown.split(), np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if keep_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean{ids_kind}")
    return out.withColumnRenamed("id", id_col)
