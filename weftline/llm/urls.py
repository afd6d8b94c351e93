"""Operator 5: allow and block lists over urls, in a broadcast trie.

The trie goes down a host's labels from the last one, and from any label into the
path, segment by segment. A rule's last segment may be part of a url's segment, as a
rule fits when the path starts with its own. Among the rules that fit, the longest
wins: most host labels first, then the longest path; of two verdicts for one rule,
block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Most rules that a broadcast trie takes, at about 0.5 KB each.
MOST_RULES = 1_000_000


@dataclass
class _Segments:
    """Paths after one host: whole segments on the way, and what a last segment may start with."""

    next: dict[str, _Segments] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()


@dataclass
class _Labels:
    next: dict[str, _Labels] = field(default_factory=dict)
    paths: _Segments | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str]], default: str = ALLOW, most: int = MOST_RULES):
        """rules: (verdict, host/path); the path starts at the first slash and may be empty."""
        self.default, self.root, n = default, _Labels(), 0
        for verdict, rule in rules:
            if (n := n + 1) > most:
                raise ValueError(f"more than {most} rules")
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.next.setdefault(label, _Labels())
            node.paths = at = node.paths or _Segments()
            *whole, last = (slash + path).split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _Segments())
            if at.ends.get(last, ("", ALLOW))[1] == ALLOW:
                at.ends[last] = rule, verdict
            at.sizes = tuple(sorted({len(x) for x in at.ends}, reverse=True))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The rule that wins, or null, and the verdict."""
        node, found = self.root, [self.root]
        for label in reversed(host.split(".")) if host else ():
            node = node.next.get(label)
            if node is None:
                break
            found.append(node)
        segments = path.split("/")
        for node in reversed(found):
            at, best = node.paths, None
            for segment in segments:
                if at is None:
                    break
                for size in at.sizes:
                    if size <= len(segment) and (hit := at.ends.get(segment[:size])):
                        best = hit
                        break
                at = at.next.get(segment)
            if best:
                return best
        return None, self.default


def host_and_path(url):
    """Columns of a url's host (after ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? or #); both empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page's host, path, the rule that wins (null if none fits) and the verdict.

    One row for each row of pages. Reads the id and the url only; no shuffle. The trie's
    size is bounded by MOST_RULES, whatever the pages.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules, default))
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")).select("id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = trie.value.judge
        for b in batches:
            got = [judge(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r for r, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], ["id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
