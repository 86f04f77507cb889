"""URL filters: a trie over reversed host labels and path segments.

Every rule is a path in one trie: the labels of its host from the top-level domain down, then a mark, then the segments of its
path.  A URL is judged by one walk: down its own labels as far as the trie goes and, at each host that has rules, down its path
segments.  The rule with the longest host decides, and among those the one with the longest path, so an entry to block can
carve a part out of an entry to allow and the other way round.  The last segment of a rule's path is compared as a prefix of
characters, so ``/en/1`` fits ``/en/17``: the prefixes of a URL's segment are looked up, the longest that a rule has first.

The trie is broadcast.  Its size is checked first: more than ``max_rules`` rules, or rules of more than ``max_bytes``, raise an
error rather than being shipped.

Special cases: a URL of any length is judged as a whole; a null URL, or one without ``://``, has an empty host and path; such a URL, and one that no rule fits, gets
the default verdict and a null rule; of equal rules that differ in the verdict, block wins; null ids and repeated rows are
judged row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_PATHS, _ENDS, _LONGEST = 0, 1, 2  # keys of a node that no label or segment can equal


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Trie of ``(verdict, host, path)`` rules."""
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict must be allow or block, not {verdict!r}")
        host = host.translate(_LOWER)
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_ENDS, {})
        node[_LONGEST] = max(node.get(_LONGEST, 0), len(last))
        if ends.get(last, ("", ""))[1] != BLOCK:
            ends[last] = (host + path, verdict)
    return root


def _best_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        ends = node.get(_ENDS)
        if ends:
            for k in range(min(node[_LONGEST], len(segment)), -1, -1):
                if (rule := ends.get(segment[:k])) is not None:
                    best = rule
                    break
        node = node.get(segment)
        if node is None:
            return best
    return best


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """``(rule, verdict)`` of the longest rule that fits."""
    segments = path.split("/")
    node, best = trie, None
    for label in (None, *reversed(host.split("."))):
        if label is not None:
            node = node.get(label)
        if node is None:
            break
        if _PATHS in node:
            best = _best_path(node[_PATHS], segments) or best
    return best


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    default: str = ALLOW,
    id_col: str = "page_id",
    url_col: str = "url",
    max_rules: int = 500_000,
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; a trie of more than {max_rules} is not broadcast")
    size = sum(len(host) + len(path) for _, host, path in rules)
    if size > max_bytes:
        raise ValueError(f"rules of {size} characters; a trie of more than {max_bytes} is not broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [match(trie.value, h, p) if h or p else None for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f[1] if f else default for f in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    columns = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return columns.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
