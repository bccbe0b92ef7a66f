"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the tokens (runs of ``[A-Za-z0-9]``) that any match
contains whole. The index keeps each rule under the one of its tokens that the fewest URLs have; a URL's own tokens fetch
its candidate rules, and only those run their expression. Rules without a whole token are candidates of every URL.
Column expressions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``rank``: among the rules that match a URL the highest rank wins, then the smallest name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    by_host: bool = True


def host_rule(verdict: str, text: str) -> Rule:
    """Rule ``host/path-prefix``: fits the host and its subdomains if the path starts with the prefix.

    Tokens of the host and those closed by a separator inside the prefix are whole in every match; the prefix's last
    token may be the beginning of a longer one.
    """
    host, slash, path = text.partition("/")
    pattern = r"^(?:[^/]*\.)?" + re.escape(host.lower()) + re.escape(slash + path)
    whole = re.findall(TOKEN, host.lower()) + re.findall(f"{TOKEN}(?![A-Za-z0-9]|$)", slash + path)
    return Rule(text, verdict, pattern, tuple(dict.fromkeys(whole)), 1000 + len(text))


def word_rule(verdict: str, word: str, rank: int = 0) -> Rule:
    """Rule for a whole token anywhere in host or path, in any case of its letters as written."""
    return Rule(word, verdict, f"(?:^|[^A-Za-z0-9]){word}(?:$|[^A-Za-z0-9])", (word,), rank, False)


RULES = tuple(
    host_rule(*x)
    for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
)
# Paths that lead to no text worth keeping; a page is judged by them only if no host rule fits.
WORDS = tuple(word_rule("block", w) for w in ("login", "signin", "signup", "checkout", "cart", "adserver", "doubleclick", "casino", "xxx"))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """One row per distinct url that a rule matches: ``url, rule, verdict, by_host`` of the winning rule.

    The table of rules is a parameter, not data; its joins are left to the optimizer, which sees its size. Urls are
    folded to distinct ones first, so a hot url costs one row, and a token that many urls share meets at most the rules
    that chose it as their rarest. A null url matches nothing. No rules: no rows.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, r.rank, r.by_host) for i, r in enumerate(rules)],
        "id int, rule string, verdict string, pattern string, rank int, by_host boolean",
    )
    literals = spark.createDataFrame(
        [(i, t) for i, r in enumerate(rules) for t in r.tokens], "id int, token string"
    )
    distinct = urls.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    canonical = F.concat(host_of(F.col("_url")), path_of(F.col("_url")))
    # The empty token stands for "every url".
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(canonical, F.lit(f"({TOKEN})"))))
    tokenised = distinct.select("_url", canonical.alias("_text"), F.explode(tokens).alias("token"))
    counts = tokenised.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        literals.join(counts, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = table.join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    hits = tokenised.join(index, "token").where(F.expr("_text rlike pattern"))
    best = F.min(F.struct((-F.col("rank")).alias("order"), "rule", "verdict", "by_host"))
    return hits.groupBy(F.col("_url").alias(url)).agg(best.alias("b")).select(url, "b.rule", "b.verdict", "b.by_host")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES + WORDS, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host, path, rule, pattern, verdict``.

    ``rule`` is the host rule that decided, ``pattern`` the word rule if none did; with neither the verdict is
    ``default``. Columns of the pages with these names are replaced. Null urls and urls without ``://`` have empty host
    and path and the default verdict. Every row is returned, repeated rows too.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    found = judge(pages, rules, url).select(F.col(url).alias("_u"), F.struct("rule", "verdict", "by_host").alias("_m"))
    return pages.join(found, pages[url] == found["_u"], "left").select(
        *[pages[c] for c in own],
        host_of(pages[url]).alias("host"),
        path_of(pages[url]).alias("path"),
        F.when(F.col("_m.by_host"), F.col("_m.rule")).alias("rule"),
        F.when(~F.col("_m.by_host"), F.col("_m.rule")).alias("pattern"),
        F.coalesce("_m.verdict", F.lit(default)).alias("verdict"),
    )
