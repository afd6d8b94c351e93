"""Operator 9: language by cross-parsing entropy.

For each language, a suffix automaton of labelled text accepts every stretch of that
text. A document is parsed from the left into the longest stretches that the automaton
accepts; each is a phrase. The fewer phrases a language needs for each character, the
nearer the document is to it.

An automaton's transitions are in three arrays: a state's base plus a symbol is a slot,
which tells the state that owns it and the one that it leads to. There is no table of
states by symbols, so alphabets have no bound.

Parsing runs over many documents at once: their texts are cut into lanes of equal
length, and all lanes take a step together in the automaton's table. A phrase ends
where a lane does, so long texts are parsed whole, with one more phrase every LANE
characters in every language alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, text_or_empty

#: Characters of labelled text for each language, and rows that they may come from, at most.
CHARS, ROWS = 16_000, 200
#: Languages that a model can have: automata take about 0.6 MB each and are broadcast. More are an error.
LANGUAGES = 500
LANE = 512


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the least automaton that accepts every stretch of codes; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
        last = new
    return go


def packed(go: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base by state, and owner and target by slot: state s goes over c to target[base[s] + c] if owner[base[s] + c] is s. Symbols start at 1."""
    owner: list[int] = []
    target: list[int] = []
    free: list[int] = [0]  # the next free slot from each one on

    def find(i: int) -> int:
        j = i
        while free[j] != j:
            j = free[j]
        while free[i] != j:
            free[i], i = j, free[i]
        return j

    def room(n: int) -> None:
        if len(owner) < n:
            more = max(n - len(owner), len(owner) // 2 + 1024)
            free.extend(range(len(free), len(free) + more))
            owner.extend([-1] * more)
            target.extend([0] * more)

    base = np.zeros(len(go), np.int32)
    for s in sorted((s for s in range(len(go)) if go[s]), key=lambda s: (-len(go[s]), s)):
        cs = sorted(go[s])
        room(cs[-1] + 1)
        slot, tries = find(cs[0]), 0
        while True:
            at = slot - cs[0]
            room(at + cs[-1] + 1)
            if all(owner[at + c] < 0 for c in cs):
                break
            tries += 1
            step = 1 if tries < 32 else tries  # ever longer steps, where gaps are too small
            room(slot + step)
            slot = find(slot + step)
        base[s] = at
        for c in cs:
            owner[at + c], target[at + c], free[at + c] = s, go[s][c], at + c + 1
    room(int(base.max(initial=0)) + symbols + 1)
    return base, np.array(owner, np.int32), np.array(target, np.int32)


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]]):
        """texts by language. Every character of them is a symbol, the commonest first; 0 is any other one."""
        from collections import Counter

        self.langs = sorted(k for k, v in texts.items() if any(map(str.strip, v)))
        if len(self.langs) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        seen = Counter("".join(normal(t) for k in self.langs for t in texts[k])) + Counter(" ")
        self.symbols = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.automata = [packed(suffix_automaton(self.code(" ".join(map(normal, texts[k]))).tolist()), len(self.symbols)) for k in self.langs]

    def code(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not hasattr(self, "_map") or self._map is None:
            self._map = np.zeros(0x110000, np.uint16 if len(self.symbols) < (1 << 16) - 1 else np.uint32)
            for i, c in enumerate(self.symbols):
                self._map[ord(c)] = i + 1
        return self._map[points]

    def __getstate__(self):
        return self.__dict__ | {"_map": None}

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language, and the texts' lengths."""
        codes = [self.code(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        kind = codes[0].dtype if codes else np.dtype(np.uint16)
        none = np.iinfo(kind).max
        grid = np.full((len(owner), LANE), none, kind)
        at = 0
        for c, n in zip(codes, lanes.tolist(), strict=True):
            grid[at : at + n].reshape(-1)[: len(c)] = c
            at += n
        length = (grid != none).sum(1)
        order = np.argsort(-length, kind="stable")  # lanes that end early leave at the end
        grid, length, owner = np.ascontiguousarray(grid[order].T), length[order], owner[order]
        out = np.zeros((len(texts), len(self.langs)))
        alive = np.searchsorted(-length, -np.arange(1, LANE + 1), "right")
        for k, (base, mine, target) in enumerate(self.automata):
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int64)
            first = np.where(mine[base[0] + np.arange(len(self.symbols) + 1)] == 0, target[base[0] + np.arange(len(self.symbols) + 1)], 0)
            for step in range(LANE):
                n = int(alive[step])
                if not n:
                    break
                c, at = grid[step, :n], state[:n]
                slot = base[at] + c
                to = target[slot]
                miss = np.flatnonzero(mine[slot] != at)
                count[:n] += at == 0  # a phrase starts
                if len(miss):
                    count[miss] += at[miss] > 0  # or ends, and the next one starts
                    to[miss] = first[c[miss]]  # a character that no phrase has is one by itself
                state[:n] = to
            out[:, k] = np.bincount(owner, count, len(texts))
        return out, sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; und and 0 if it has no letter or no language is learned."""
        clean = [normal(t) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for part in _spans([len(t) for t in clean], 4_000_000):
            n, sizes = self.phrases([clean[i] for i in part])
            cost = n / np.maximum(sizes, 1)[:, None]
            p = np.exp(-np.minimum(30, sizes)[:, None] * (cost - cost.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            out += [(self.langs[k], float(q[k])) if any(map(str.isalpha, texts[i])) else ("und", 0.0) for i, k, q in zip(part, best.tolist(), p, strict=True)]
        return out


def _spans(sizes: list[int], most: int) -> Iterator[list[int]]:
    part, total = [], 0
    for i, n in enumerate(sizes):
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(i)
        total += n
    if part:
        yield part


def normal(text: str) -> str:
    return text.lower()


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, chars: int = CHARS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows that aren't held out and have a language: of each language those with the smallest hashes of ids, up to `rows`, and up to `chars` in all.

    Of a text that is longer than its share a stretch counts that starts at a hashed
    place. Raises ValueError where there are more than LANGUAGES languages.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(~held_out(id_col), F.lit(False)))
    each = max(1, 2 * chars // rows)
    h = F.xxhash64(F.lit(5), F.col(id_col))
    start = F.pmod(F.xxhash64(F.lit(6), F.col(id_col)), F.greatest(F.lit(1), F.length(text_col) - each + 1)).cast("int") + 1
    known = known.select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(text_col, start, F.lit(each)).alias("text")).where(F.rlike("text", F.lit(r"\p{L}")))
    # about four times the rows that are wanted, by a hash of the id, so that the bound doesn't cost a sort of all rows
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return LanguageModel({})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 4 * rows / n))]), F.col("lang"))
    near = known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    some = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= rows)
    texts: dict[str, list[str]] = {}
    for r in sorted(some.select("lang", "h", "text").collect()):  # as many rows as `rows` for each language, `each` characters long
        got = texts.setdefault(r["lang"], [])
        if sum(map(len, got)) < chars:
            got.append(r["text"])
    return LanguageModel(texts)


def identify(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row's held_out, lang_pred and score (0 to 1).

    lang_pred is und, with score 0, where the text is null or has no letter; of equal
    languages the first by name. A null id isn't held out, and isn't learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
