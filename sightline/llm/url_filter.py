"""URL filters: a broadcast trie over reversed host labels and path segments.

Defined results
* null url or no ``://``: host and path are empty, no rule fits, the default verdict holds;
* a rule fits its host and every subdomain, if the url's path starts with the rule's path;
* several fitting rules: the one with most host labels wins, then the longest path; of two
  entries for the same host and path the ``block`` entry wins, whatever their order;
* repeated urls are judged alike; an empty table gives an empty result; columns of the input
  other than the id and the url are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many characters in all are broadcast as a trie; more of them are joined.
TRIE_MAX_CHARS = 64_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url, empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Host labels from the right, then path segments; the last piece of a rule's path is a prefix of a segment."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, host: str, path: str, action: str) -> None:
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        *segments, tail = path.split("/")
        node = node.setdefault(("path",), {})
        for segment in segments:
            node = node.setdefault(segment, {})
        tails = node.setdefault(("tails",), {})
        if tails.get(tail, ("", ""))[1] != "block":
            tails[tail] = (host + path, action)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and action that win, if any rule fits."""
        if not host:
            return None
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if ("path",) in node:
                nodes.append(node[("path",)])
        segments = path.split("/")
        for node in reversed(nodes):
            best, best_length, done = None, -1, 0
            for i, segment in enumerate(segments):
                rest = None
                for tail, found in node.get(("tails",), {}).items():
                    rest = "/".join(segments[i:]) if rest is None else rest
                    if done + len(tail) > best_length and rest.startswith(tail):
                        best, best_length = found, done + len(tail)
                done += len(segment) + 1
                if i + 1 == len(segments) or (node := node.get(segment)) is None:
                    break
            if best:
                return best
        return None


def _judge_by_trie(parts: DataFrame, trie: RuleTrie) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, action string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for hosts, paths in batches:
            yield pd.DataFrame([rules.find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "action"])

    return parts.withColumn("__found", find("host", "path")).select("*", "__found.rule", "__found.action").drop("__found")


def _judge_by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule lists beyond a broadcast: each distinct host and path meets the rules of its host suffixes; Spark splits hot suffixes."""
    keyed = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        keyed.filter("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("__suffix"))
        .join(rules.select(F.col("host").alias("__suffix"), F.col("path").alias("__start"), F.col("action").alias("__action")), "__suffix")
        .filter(F.col("path").startswith(F.col("__start")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.size(F.split("__suffix", r"\.")), F.length("__start"), F.col("__action"), F.concat("__suffix", "__start").alias("rule"))).alias("__best"))
    )
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, F.col("__best.rule").alias("rule"), F.col("__best.__action").alias("action"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", trie_max_chars: int = TRIE_MAX_CHARS) -> DataFrame:
    """One row per input row: id, host, path, the rule that won (host + path; null if none) and the verdict.

    rules has the columns host, path and action (``allow`` or ``block``).
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 50), F.lit(0))).first()[0]
    if size <= trie_max_chars:
        trie = RuleTrie()
        for r in rules.select("host", "path", "action").collect():
            trie.add(r.host, r.path, r.action)
        judged = _judge_by_trie(parts, trie)
    else:
        judged = _judge_by_join(parts, rules)
    return judged.select(id_col, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


#: The rules of the registered query: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
