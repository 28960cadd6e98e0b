"""URL filters: host and path rules, then pattern rules looked up by their rarest token.

Each pattern rule is indexed under the one of its literal tokens that is rarest among
the URLs' tokens, counted in Spark. The tokens of a URL fetch the rules indexed under
them, and only those run their regular expression. Rules without a literal token are
few by construction (`always`), and run on every URL.

Defined results
- null url, or one without ://: empty host and path, no rule, allowed by default.
- a host or path rule decides first (the longest that fits; an equally long one: the
  one first in order); then any matching block pattern that no matching allow pattern
  overrides; else allow. `patterns` lists the matching patterns' ids in order, comma-joined.
- repeated rows each get the same result; an empty table gives none; other columns are
  not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import BROADCAST_ROWS, cut_lineage

#: (verdict, host, path), stated by the contract.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (id, verdict, pattern); * stands for any run of characters, ^ for a character that is
#: neither letter nor digit, or for an end of the URL.
PATTERNS = (
    ("ads-host", "block", "://*^ads^*/"),
    ("ad-host", "block", "://*^ad^*/"),
    ("ads-path", "block", "/ads/"),
    ("advert", "block", "^advert^"),
    ("adverts", "block", "^adverts^"),
    ("banner-path", "block", "/banner/"),
    ("banners-path", "block", "/banners/"),
    ("track-host", "block", "://*^track^*/"),
    ("tracker", "block", "^tracker^"),
    ("casino", "block", "^casino^"),
    ("bets", "block", "^bets^"),
    ("betting", "block", "^betting^"),
    ("poker", "block", "^poker^"),
    ("porn", "block", "^porn^"),
    ("xxx", "block", "^xxx^"),
    ("adult", "block", "^adult^"),
    ("malware", "block", "^malware^"),
    ("phishing", "block", "^phishing^"),
    ("warez", "block", "^warez^"),
    ("torrent", "block", "^torrent^"),
    ("pills", "block", "^pills^"),
    ("payday", "block", "^payday^loan"),
    ("doubleclick", "block", "doubleclick"),
    ("ad-policy", "allow", "/about/ads/policy^"),
)
TOKEN = "[a-z0-9]+"


def regex_of(pattern: str) -> str:
    """The pattern as a regular expression over the lower-cased URL."""
    parts = re.split(r"([*^])", pattern)
    said = {"*": "[^ ]*", "^": "(?:^|[^a-z0-9]|$)"}
    return "".join(said.get(p) or re.sub(r"([^a-z0-9/:])", r"\\\1", p) for p in parts)


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that a matching URL must hold whole: literal runs bounded by other characters on both sides."""
    return [m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", pattern) if m.start() > 0 and m.end() < len(pattern)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, "(?s)" + pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, "(?s)" + pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for how, of, start in reversed(ordered):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, how).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def rule_index(spark: SparkSession, urls: DataFrame, patterns=PATTERNS) -> DataFrame:
    """(token, id, how, regex): each pattern under its rarest literal token; those without one under ''.

    Ties go to the token first in order.
    """
    named = [(i, how, regex_of(p), t) for i, how, p in patterns for t in (literal_tokens(p) or [""])]
    rules = spark.createDataFrame(named, "id string, how string, regex string, token string")
    seen = (
        urls.select(F.explode(tokens(F.col("url"))).alias("token"))
        .join(_hinted(rules.select("token").distinct(), len(named)), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = rules.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cut_lineage(counted.groupBy("id", "how", "regex").agg(F.min_by("token", F.struct("n", "token")).alias("token")))


def _hinted(rules: DataFrame, n: int) -> DataFrame:
    """Rule tables are as long as the rule list: broadcast up to a bound, else joined as any table."""
    return F.broadcast(rules) if n <= BROADCAST_ROWS else rules


def judge(urls: DataFrame, id_col: str = "page_id", rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """id, host, path, rule, verdict and the patterns that match."""
    spark = urls.sparkSession
    read = urls.select(id_col, "url")
    index = _hinted(rule_index(spark, read, patterns), len(patterns))
    named = F.lower(F.coalesce("url", F.lit("")))
    fetched = (
        read.select("url", named.alias("_url"))
        .distinct()
        .select("url", "_url", F.explode(F.array_append(tokens(F.col("url")), F.lit(""))).alias("token"))
        .join(index, "token")
        .filter(F.expr("_url rlike regex"))
        .groupBy("url")
        .agg(F.array_sort(F.collect_set("id")).alias("patterns"), F.bool_or(F.col("how") == "allow").alias("_allowed"))
    )
    host, path = host_and_path(F.col("url"))
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    by_pattern = F.when(F.col("patterns").isNotNull() & ~F.col("_allowed"), "block").otherwise("allow")
    joined = read.withColumns({"host": host, "path": path}).join(fetched, "url", "left")
    return joined.select(
        id_col,
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, by_pattern).alias("verdict"),
        F.array_join(F.coalesce("patterns", F.array().cast("array<string>")), ",").alias("patterns"),
    )
