"""URL filters: a blocked Bloom filter before an exact hash join (operator 7).

A rule is a host and a path; its canonical URL is both written together (``net/``,
``example.net/en/``). It fits every URL whose host is the rule's host or a subdomain of
it and whose path starts with the rule's path. So the canonical URLs that could fit a URL
are its host suffixes, each with the prefixes of its path that have the length of a
listed path. These candidates are probed against the Bloom filter of the listed URLs;
the few that pass go to a hash join with the list, which removes false positives. Of the
rules that fit the longest wins (equal lengths: the first in text order).

DataFrame functions only. Each page gives a handful of candidates, which are filtered
before the only shuffles: of the possible hits and of the page keys.

Defined results: a null URL or one without ``://`` has an empty host and path and no
rule; a page without a rule gets the default verdict; a null ``page_id`` is kept;
repeated rows give repeated results; rules with a null field are ignored; of rules with
the same canonical URL ``block`` wins. Extra columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.bloom import BlockedBloom
from sparkpul.llm.common import ascii_lower

DEFAULT = "allow"
#: distinct path lengths a rule list may have; each one adds a candidate per host suffix
MAX_LENGTHS = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``rules`` has ``host, path, verdict``. The distinct path lengths of the list are
    collected (at most ``MAX_LENGTHS``, checked); everything else stays in Spark.
    """
    listed = rules.select(
        F.concat(ascii_lower(F.col("host")), F.col("path")).alias("rule"),
        F.length("path").alias("path_length"),
        "verdict",
    ).where("rule is not null and verdict is not null")
    lengths = [r[0] for r in listed.select("path_length").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"the rules have more than {MAX_LENGTHS} path lengths; round paths to whole segments")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    # equal pages share a verdict: judge each host and path once
    addresses = parsed.select("host", "path").distinct()
    possible = addresses.select(
        "host", "path", F.explode(_candidates(F.col("host"), F.col("path"), sorted(lengths))).alias("rule")
    )
    exact = listed.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    hits = BlockedBloom(exact, "rule").possible(possible, "rule").join(exact, "rule")
    best = hits.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
