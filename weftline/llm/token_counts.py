"""Operator 4: token counts of sections, from one encoding of the whole document.

Sections are stretches of a text. Their tokens aren't those of the section on its
own: the document is encoded once, each token is mapped to the characters that its
bytes belong to, and goes to sections in one merge of these spans with the sorted
borders of the sections. A token with some of a character's bytes has that character. A
token that crosses a border is allocated by a rule:

- first: to the section of its first character
- last: to the section of its last character
- most: to the section with most of its characters, the earlier one if equal
- split: to each section in proportion to its characters
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bytepairs import byte_pairs
from weftline.llm.common import small_batches, text_or_empty

RULES = ("first", "last", "most", "split")


def line_ends(text: str) -> np.ndarray:
    """Ends of the lines of a text, in characters; a line feed belongs to the line before it."""
    lines = text.split("\n")
    at = np.cumsum([len(x) + 1 for x in lines])
    at[-1] -= 1
    return at[:-1] if len(at) > 1 and not lines[-1] else at


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last, for tokens of so many bytes."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum(raw & 0xC0 != 0x80) - 1
    return char[starts], char[np.maximum(ends - 1, 0)] + 1


def allocate(starts: np.ndarray, token_ends: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross one of its borders. All lists are sorted, and ends reach the text's end."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    a = np.searchsorted(ends, starts, "right")
    b = np.searchsorted(ends, np.maximum(token_ends - 1, starts), "right")
    a, b = np.minimum(a, len(ends) - 1), np.minimum(b, len(ends) - 1)
    cross = a != b
    count = np.bincount(a[~cross] if rule != "first" else a, minlength=len(ends)).astype(float)
    crossing = np.zeros(len(ends), np.int64)
    for i in np.flatnonzero(cross):
        crossing[a[i] : b[i] + 1] += 1
        if rule == "first":
            continue
        borders = np.concatenate([[starts[i]], ends[a[i] : b[i]], [token_ends[i]]])
        parts = np.diff(borders)
        if rule == "last":
            count[b[i]] += 1
        elif rule == "most":
            count[a[i] + int(parts.argmax())] += 1
        else:
            count[a[i] : b[i] + 1] += parts / parts.sum()
    return count, crossing


def section_tokens(docs: DataFrame, tokenizer_json: str, rule: str = "first", sections: Callable[[str], np.ndarray] = line_ends, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section of each document: id, section (from 0), start_char, end_char, n_tokens (double), n_crossing and doc_tokens.

    sections gives the sorted ends of a text's sections, in characters. Null text counts as empty;
    an empty text has one empty section. A document's n_tokens add up to its doc_tokens.
    Special tokens' texts are ordinary text. Repeated rows are documents of their own and
    a null id stays null; other columns aren't looked at. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(vocabulary.value, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # the sections of few documents at a time
                some = batch.slice(at, 512)
                texts = some.column(1).to_pylist()
                take, cols = [], [[] for _ in range(6)]
                for i, (text, ids) in enumerate(zip(texts, pairs.encode_all(texts), strict=True)):
                    sizes = pairs.byte_sizes[np.frombuffer(ids, "<u4")]
                    ends = sections(text)
                    count, crossing = allocate(*spans(text, sizes), ends, rule)
                    take.append(np.full(len(ends), i))
                    for c, x in zip(cols, (np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, count, crossing, np.full(len(ends), len(sizes))), strict=True):
                        c.append(x)
                ids = some.column(0).take(pa.array(np.concatenate(take)))
                made = [pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *made], ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)
