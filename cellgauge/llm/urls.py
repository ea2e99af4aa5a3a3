"""URL filter: a trie over reversed host labels and path segments decides each url.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
Path: what follows up to `?`, `#` or the end. A null url, or one without `://`, has
both empty, fits no rule and gets the default verdict. A rule fits its host and every
subdomain of it if the url's path starts with the rule's; of those that fit, the one
with the most host labels wins, then the one with the longest path, then a block entry
over an allow entry. Repeated rows are judged each, urls of any length whole; an empty table
gives an empty one, and without rules every url gets the default verdict. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free

#: A trie of more rules, or of more characters, isn't broadcast; a join judges the urls then.
MAX_RULES = 200_000
MAX_CHARS = 16_000_000

VERDICT = "host string, path string, rule string, verdict string"


class Rule(NamedTuple):
    action: str
    host: str
    path: str = "/"


class UrlTrie:
    """Nodes are dicts. Host labels hang from the right; under the key None are the path segments."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for r in rules:
            if r.action not in ("allow", "block"):
                raise ValueError(f"unknown action {r.action!r}")
            node = self.root
            for label in reversed(r.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = r.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # The last segment may be a part of the url's: "/en/2" fits "/en/25".
            ends = node.setdefault(None, {})
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (r.action, f"{r.host.lower()}{r.path}")

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best

    @staticmethod
    def _path(node: dict, path: str):
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            ends = node.get(None)
            if ends:
                # A rule's last part, the longest first, must start what is left of the path.
                rest = segment if i == len(segments) - 1 else segment + "/"
                fits = [e for e in ends if rest.startswith(e)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _by_trie(df: DataFrame, url: str, rules: list[Rule], default: str) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(VERDICT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            host, path = split_url(u)
            found = trie.value.find(host, path)
            out.append((host, path, found[1] if found else None, found[0] if found else default))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

    return df.withColumn("_judged", judge(F.col(url)))


def _by_join(df: DataFrame, url: str, rules: DataFrame, default: str) -> DataFrame:
    """For rule sets of any size: each distinct url meets the rules of its host's suffixes."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    head = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(head, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = df.select(F.col(url).alias("_u")).distinct().withColumnRenamed("_u", url).select(F.col(url).alias("_u"), host.alias("_h"), F.regexp_extract(head, r"(?s)^[^/]*(.*)$", 1).alias("_p"))
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.lower("host").alias("_rh"), F.col("path").alias("_rp"), F.col("action").alias("_ra"))
    fits = urls.select("_u", "_p", F.explode(suffixes).alias("_rh")).join(r, "_rh").where(F.col("_p").startswith(F.col("_rp")))
    best = fits.groupBy("_u").agg(F.max(F.struct(F.size(F.split("_rh", r"\.")).alias("a"), F.length("_rp").alias("b"), F.col("_ra"), F.concat("_rh", "_rp").alias("rule"))).alias("_b")).withColumnRenamed("_u", "_v")
    judged = urls.join(best, F.col("_u").eqNullSafe(F.col("_v")), "left").select("_u", F.struct(F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_b.rule").alias("rule"), F.coalesce("_b._ra", F.lit(default)).alias("verdict")).alias("_judged"))
    u = free(df, "_u")
    judged = judged.withColumnRenamed("_u", u)
    return df.join(judged, df[url].eqNullSafe(judged[u]), "left").drop(u)


def filter_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES, max_chars: int = MAX_CHARS) -> DataFrame:
    """df and, as struct `_judged`, host, path, rule and verdict of each row's url.

    The trie is broadcast only when the rules number at most max_rules and hold at most
    max_chars characters, which is counted first; a larger set is joined instead, with the
    same answers. A column `_judged` of df is replaced. Empty tables give empty results; repeated rows are judged alike.
    """
    spark = df.sparkSession
    df = df.drop("_judged")
    if isinstance(rules, DataFrame):
        n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat("host", "path"))), F.lit(0))).first()
        if n > max_rules or chars > max_chars:
            return _by_join(df, url, rules, default)
        rules = [Rule(r["action"], r["host"], r["path"]) for r in rules.select("action", "host", "path").collect()]
    elif len(rules) > max_rules or sum(len(r.host) + len(r.path) for r in rules) > max_chars:
        return _by_join(df, url, spark.createDataFrame(rules, "action string, host string, path string"), default)
    return _by_trie(df, url, list(rules), default)
