"""URL allow and block lists: a broadcast trie over reversed host labels, then path segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_type

#: Characters of rules that are broadcast as a trie at most; more rules are joined by their keys, with the same result.
TRIE_CHARS = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Rules (host, path, verdict): a node per host label from the right, then one per path segment.

    A rule fits its host and all subdomains if the url's path starts with the rule's.  The longest
    fitting rule wins: the one with the most host labels, then with the longest path.  An empty host
    fits every host.  Under a node, what must follow the segments is looked up by each of its lengths
    there, longest first, so a url costs as much as its own length whatever the number of rules.
    """

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(0, {})  # 0: the paths of this host
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(1, {})  # 1: by length, what must follow the segments, and the rule
            ends.setdefault(len(rest), {})[rest] = f"{host}{path}", verdict
        todo = [self.root]
        while todo:
            node = todo.pop()
            if 1 in node:
                node[1] = dict(sorted(node[1].items(), reverse=True))
            todo += [child for key, child in node.items() if key != 1]

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        nodes, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            nodes.append(node)
        for node in reversed(nodes):
            node, at, found = node.get(0), 0, None
            while node is not None:
                for n, rests in node.get(1, {}).items():
                    if n <= len(path) - at and (hit := rests.get(path[at : at + n])):
                        found = hit
                        break
                end = path.find("/", at)
                node = node.get(path[at:end]) if end >= 0 else None
                at = end + 1
            if found:
                return found
        return None


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(id, host, path, rule, verdict) for each row; rules are rows (host, path, verdict).

    Null urls and urls without :// have an empty host and path, which no rule with a host fits.
    Without a fitting rule, rule is null and verdict is ``default``.  Rules with a null part are
    left out; of equal rules with different verdicts block counts, else the greatest.  Up to
    ``trie_chars`` characters of rules are broadcast as a trie; a longer list, with the same result,
    is joined to the urls on host suffixes and path prefixes.
    Rows are independent; repeated ids give repeated rows; an empty table gives none.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
    rules = rules.agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    plain = plain.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.char_length("host") + F.char_length("path") + 16), F.lit(0))).first()[0]
    return _by_trie(plain, rules, default) if size <= trie_chars else _by_join(plain, rules, default)


def _by_trie(plain: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    shared = plain.sparkSession.sparkContext.broadcast(RuleTrie([(r.host, r.path, r.verdict) for r in rules.collect()]))

    def run(batches):
        trie = shared.value
        for batch in batches:
            found = [trie.match(h, p) or (None, default) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["id", "host", "path", "rule", "verdict"])

    return plain.mapInArrow(run, f"id {id_type(plain, 'id')}, host string, path string, rule string, verdict string")


def _by_join(plain: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by equal keys: host suffix and whole path segments, then what must follow them, by its length."""
    whole = "left(path, char_length(path) - char_length(substring_index(path, '/', -1)))"
    rules = cut(rules.select("host", F.expr(whole).alias("whole"), "path", "verdict"))
    lengths = rules.groupBy("host", "whole").agg(F.collect_set(F.char_length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    )
    segments = F.split("path", "/")
    wholes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.concat(F.slice(segments, 1, k - 1), F.array(F.lit(""))), "/"))
    # each host and path once
    rows = plain.select("host", "path").distinct()
    keys = rows.select(F.col("host").alias("own"), "path", F.explode(suffixes).alias("host"))
    keys = keys.select("own", F.col("path").alias("full"), "host", F.explode(wholes).alias("whole")).join(lengths, ["host", "whole"])
    keys = keys.select("own", "full", "host", F.explode("lengths").alias("n")).where(F.char_length("full") >= F.col("n"))
    hits = keys.withColumn("path", F.expr("left(full, n)")).join(rules.select("host", "path", "verdict"), ["host", "path"])
    rank = F.struct(F.when(F.col("host") == "", 0).otherwise(F.size(labels)).alias("labels"), "n", F.concat("host", "path").alias("rule"), "verdict")
    won = hits.groupBy(F.col("own").alias("host"), F.col("full").alias("path")).agg(F.max(rank).alias("w"))
    out = plain.join(won, ["host", "path"], "left")
    return out.select("id", "host", "path", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))
