"""URL rules through a broadcast trie (7).

A rule is a host and a path prefix (``example.net/en/``).  The trie's first
levels are the host's labels from the right, so a walk from the root meets
every rule of the host and its parent domains; below a host hang the path's
segments.  The longest fitting rule wins (host labels, then path), allow and
block alike; a URL that no rule fits gets the default verdict.

The trie is broadcast only while the rules' text stays under
``MAX_RULE_BYTES``; a larger list is refused with a ValueError, because a rule
file is an operator's parameter and not data that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import ship_by_value

ship_by_value(__name__)

MAX_RULE_BYTES = 32 * 1024 * 1024


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


class Node:
    __slots__ = ("labels", "segments", "ends", "prefixes")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: tuple[str, str] | None = None
        #: rules that end inside a segment, by that part of it
        self.prefixes: dict[str, tuple[str, str]] = {}


def build_trie(rules: Iterable[tuple[str, str]]) -> Node:
    """``rules``: (verdict, rule) pairs.  Of equal rules block wins."""
    root, size = Node(), 0
    for verdict, rule in sorted(rules):
        size += len(rule)
        if size > MAX_RULE_BYTES:
            raise ValueError(f"rules exceed {MAX_RULE_BYTES} bytes")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = (slash + path).split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if last:
            node.prefixes[last] = (verdict, rule)
        else:
            node.ends = (verdict, rule)
    return root


def _in_path(node: Node, segments: list[str]) -> tuple[str, str] | None:
    """The longest rule below a host's node that the path starts with."""
    best = node.ends
    for k, segment in enumerate(segments):
        for n in range(len(segment), 0, -1) if node.prefixes else ():
            if hit := node.prefixes.get(segment[:n]):
                best = hit
                break
        if k == len(segments) - 1 or (node := node.segments.get(segment)) is None:
            break
        best = node.ends or best
    return best


def judge(root: Node, url: str | None) -> tuple[str, str, str | None, str | None]:
    """(host, path, rule, the rule's verdict)."""
    host, path = split_url(url)
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")) if host else ():
        node = node.labels.get(label)
        if node is None:
            break
        best = _in_path(node, segments) or best
    return host, path, best[1] if best else None, best[0] if best else None


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow",
                id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``; reads only
    the id and ``url``.  A null url has an empty host and path and gets the
    default; repeated rows are judged alike."""
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(build_trie(rules))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            out = [judge(root, u) for u in batch.column(1).to_pylist()]
            host, path, rule, verdict = (list(c) for c in zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()),
                 pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, "url").mapInArrow(
        run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
