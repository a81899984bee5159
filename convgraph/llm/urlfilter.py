"""Allow and block lists for urls: a trie over reversed host labels and path segments.

A rule ``host/path`` fits its host and all subdomains when the url's path starts with the rule's path.  Of the fitting
rules the one with the most host labels wins, then the one with the longest path; of an allow and a block entry for the
same host and path the block wins.  Without a fitting rule the verdict is ``default``.

Scale: no shuffle; only the url column is read.  The trie travels with the task; it is built from a list of rules given
by the caller and refused beyond ``MAX_RULE_BYTES``, so what is broadcast has a fixed bound.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; empty tables stay empty;
repeated rows are judged alike; other columns pass through unless their names clash with the four added ones, which win.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Nodes are dicts of labels, host labels from the right; a host's paths form a second trie of whole segments.

    The last segment of a rule's path may be the beginning of a longer one, so it is kept apart, under ``starts``.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        size = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            size += len(rule) + 64
            if size > MAX_RULE_BYTES:
                raise ValueError(f"the rules exceed {MAX_RULE_BYTES} bytes")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "starts": {}}
            *whole, last = (slash + path).split("/")[1:] or [""]
            at = node["paths"]
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "starts": {}})
            if at["starts"].get(last, (None, "allow"))[1] != "block":
                at["starts"][last] = (rule, verdict)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        segments, best = path.split("/")[1:] if path.startswith("/") else None, None
        if segments is None:
            return None
        for k, segment in enumerate(segments):
            for n in range(len(segment), -1, -1):
                if segment[:n] in node["starts"]:
                    best = node["starts"][segment[:n]]
                    break
            node = node["next"].get(segment)
            if node is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._path(node["paths"], path) or best
        return best or (None, None)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row; ``rules`` are (verdict, "host/path")."""
    trie = RuleTrie(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [trie.judge(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    host, path = host_and_path(F.col(url))
    df = pages.withColumns({"host": host, "path": path}).withColumn("_judged", judge("host", "path"))
    return df.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")
