"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks.

A rule (action, host, path) fits a URL whose host is the rule's or below it and whose path starts with the rule's path. Among
the rules that fit, the longest wins: most host labels first, then the longest path, and a block before an allow.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Rules beyond this number are refused: the trie goes to every task, so its size must be bounded.
MAX_RULES = 200_000


class Rule(NamedTuple):
    action: str
    host: str
    path: str


class RuleTrie:
    """Host labels from the top-level domain down; under each host a second trie of path segments.

    A path such as /en/ is the closed segment "en" followed by an open one, which any further text continues; /fo is one open
    segment that /foo continues too. So the path trie holds closed segments as edges and open ones as prefixes at its nodes.
    """

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie takes {MAX_RULES} at most")
        self.root: dict = {}
        for rule in rules:
            if rule.action not in ("allow", "block"):
                raise ValueError(f"action {rule.action!r} is neither allow nor block")
            node = self.root
            for label in reversed(lower_ascii(rule.host).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *closed, opened = rule.path.split("/")
            for segment in closed:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("open", {})
            if opened not in ends or rule.action == "block":
                ends[opened] = (rule.action, lower_ascii(rule.host) + rule.path)

    def decide(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits, or None."""
        best, node = None, self.root
        segments: list[str] | None = None
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                segments = path.split("/") if segments is None else segments
                best = longest_path(node["paths"], segments) or best
        return best


def longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for k, segment in enumerate(segments):
        ends = node.get("open")
        if ends:
            best = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), best)
        node = node.get("segments", {}).get(segment) if k + 1 < len(segments) else None
        if node is None:
            break
    return best


LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(s: str) -> str:
    return s.translate(LOWER)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without ://."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return lower_ascii(host), slash + path


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url.

    Where no rule fits, rule is null and the verdict is `default`. Null and malformed urls have an empty host and path, which
    no rule fits. Rows are judged one by one, so repeated rows, ties and nulls in page_id stay as they are; other columns are
    left out. The trie (MAX_RULES rules at most, checked) is broadcast; the table is read for two columns and not shuffled.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [host_and_path(x) for x in batch.column(1).to_pylist()]
        found = [trie.value.decide(*x) for x in parts]
        columns = [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([x and x[1] for x in found], pa.string()), pa.array([x[0] if x else default for x in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return map_arrow(plain, run, "page_id bigint, host string, path string, rule string, verdict string")
