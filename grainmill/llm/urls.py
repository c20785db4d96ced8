"""URL filters: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule fits its host and all subdomains when the url's path starts with the rule's path. The rule of the deepest host
wins, then that of the longest path; this holds between allow and block rules alike, and of an allow and a block rule of the
same host and path the allow rule holds. Rules up to ``MOST_RULES`` are broadcast as a trie; a longer list, or a table of
rules, is joined by host suffix and path folder instead, with the same results.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; null ids are kept; urls of any
length are judged whole and row by row, so repeated rows get equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: The bound of the broadcast: so many rules of at most MOST_LENGTH characters are some tens of MB.
MOST_RULES, MOST_LENGTH = 100_000, 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to a slash, question mark or hash; A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts from host label to node; a host's rules hang below ``None`` as a second trie over path segments.

    In the path trie, the whole segments of a rule lead to a node, whose entries are (rest, verdict, rule): the rest is
    what the rule has after its last slash, the beginning of the next segment.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((rest, verdict, host + path))
            node[None].sort(key=lambda x: (-len(x[0]), x[1], x[2]))

    @staticmethod
    def _longest(node: dict, path: str) -> tuple[str, str] | None:
        best, parts = None, path.split("/")
        for segment in parts:
            best = next(((verdict, rule) for rest, verdict, rule in node.get(None, ()) if segment.startswith(rest)), best)
            if (node := node.get(segment)) is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node:
                best = self._longest(node[None], path) or best
        return best


def _by_trie(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]}, dtype=object)

    return parts.withColumn("__gm", judge("host", "path")).select(*parts.columns, "__gm.rule", "__gm.verdict")


def _before(path: str, n: Column) -> Column:
    """What stands before the slash of this number."""
    return F.call_function("substring_index", F.col(path), F.lit("/"), n.cast("int"))


def _by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join on host suffix and path folder (all of a path up to a slash): a page has as many suffixes as labels, and folders down to the deepest rule's."""
    rows = written(parts.withColumn("__gm_no", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    r = r.withColumn("folder", _before("r_path", slashes(F.col("r_path"))))
    deepest = rules.agg(F.coalesce(F.max(slashes(F.col("path"))), F.lit(0))).first()[0]
    folders = F.transform(F.sequence(F.lit(0), F.least(slashes(F.col("path")), F.lit(deepest))), lambda n: _before("path", n))
    own = rows.select("__gm_no", "path", F.explode(suffixes).alias("r_host"), folders.alias("folders"))
    own = own.select("__gm_no", "path", "r_host", F.explode(F.array_distinct("folders")).alias("folder"))
    hit = own.join(r, ["r_host", "folder"]).where("startswith(path, r_path)")
    rank = F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"))
    best = hit.groupBy("__gm_no").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("b"))
    return rows.join(best, "__gm_no", "left").select(*parts.columns, F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row. A rule is (verdict, host, path), or a row of columns of these names."""
    parts = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        return _by_join(parts, rules, default)
    if len(rules) > MOST_RULES or any(len(h) + len(p) > MOST_LENGTH for _, h, p in rules):
        return _by_join(parts, df.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    return _by_trie(parts, rules, default)
