"""URL allow and block lists as a trie over reversed host labels and path segments.

A rule is a host and a path prefix. It fits its host and every subdomain if the
path of the URL starts with the rule's path; of the rules that fit, the one with
the most host labels, then the longest path, decides. The trie holds the rules
only, at most ``MAX_RULES``, and travels to the tasks once as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000  # bounds the broadcast; a list beyond it is refused


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # a prefix, with its first slash

    @property
    def name(self) -> str:
        return self.host + self.path


class Node:
    """One label or segment; ``tails`` are path rules that end inside the next segment."""

    __slots__ = ("labels", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.tails: list[tuple[str, Rule]] = []


def build_trie(rules: Sequence[Rule]) -> Node:
    """Of rules with the same host and path the first counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, tail = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if all(t != tail for t, _ in node.tails):
            node.tails.append((tail, rule))
            node.tails.sort(key=lambda x: -len(x[0]))
    return root


def longest_match(root: Node, host: str, path: str) -> Rule | None:
    """The deepest rule that fits; walks each label and segment once per host depth."""
    hosts, node = [], root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        hosts.append(node)
    segments = path.split("/")
    for start in reversed(hosts):  # a longer host wins over any path
        found, node = None, start
        for segment in segments:
            for tail, rule in node.tails:
                if segment.startswith(tail):
                    found = rule
                    break
            node = node.segments.get(segment)
            if node is None:
                break
        if found:
            return found
    return None


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, which fit no
    rule with a host; without a fitting rule ``rule`` is null and ``verdict`` the
    default. Repeated rows and null ids are kept, other columns are ignored.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            found = [longest_match(root, host, path) for host, path in pairs]
            names = pa.array([r.name if r else None for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, names, verdicts], [*batch.schema.names, "rule", "verdict"]
            )

    parts = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    kind = parts.schema["id"].dataType.simpleString()
    judged = parts.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)
