"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over `host || path` with some literal tokens that any url
it matches must hold. The rule is filed under the one of them that the fewest urls hold
(counted over all urls). The tokens of a url fetch the rules filed under them, in a join on
the token, and only those regular expressions run. Work grows with the number of
(url, fetched rule) pairs, not with urls times rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule list up to this length is broadcast; a longer one is joined by a shuffle on the token.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class HostRule:
    """host/path: fits the host and its subdomains where the url's path starts with the path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        ended = self.path if re.search(r"[^A-Za-z0-9]$", self.path) else re.sub(r"[A-Za-z0-9]+$", "", self.path)
        return re.findall("[a-z0-9]+", (self.host + ended).lower())


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over `host || path` and literal tokens that every match holds whole."""

    name: str
    pattern: str
    literals: Sequence[str] = field(default=())
    verdict: str = "block"

    def regex(self) -> str:
        return self.pattern

    def tokens(self) -> list[str]:
        return list(self.literals)


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
PATTERN_RULES = tuple(PatternRule(f"{a}-{b}", rf"(?:^|[.-]){a}-{b}\.", (a, b)) for a, b in (("spam", "farm"), ("adult", "x"), ("cheap", "pills"), ("free", "bets"), ("casino", "win"), ("ads", "track")))


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def host_and_path(url):
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, patterns.

    rule is the longest host rule that fits (null if none) and gives the verdict; else a
    matching pattern rule with verdict block blocks, one with allow allows, and `default`
    holds. patterns lists the pattern rules that match. A null url, or one without `://`, has
    an empty host and path, fits no rule and gets the default; so does an empty one. Repeated urls are judged once,
    very long ones whole, and every row keeps its result. Of matching pattern rules of both verdicts block wins. An empty table gives an empty result.
    A rule without any literal token is an error: it would have to run on every url.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = pages.select("host", "path").where("host <> ''").distinct().withColumn("at", F.concat("host", "path"))
    rows = [(r.name, i < len(host_rules), r.verdict, r.regex(), r.tokens()) for i, r in enumerate([*host_rules, *pattern_rules])]
    if blind := [r[0] for r in rows if not r[4]]:
        raise ValueError(f"no literal token to file these rules under: {blind}")
    names = ("rule", "by_host", "rule_verdict", "regex", "literals")
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), "array<struct<rule:string,by_host:boolean,rule_verdict:string,regex:string,literals:array<string>>>")
    rules = spark.range(1).select(F.inline(listed))
    small = F.broadcast if len(rows) <= BROADCAST_RULES else (lambda df: df)

    tokens = places.withColumn("token", F.explode(F.array_distinct(F.split(lower_ascii(F.col("at")), "[^a-z0-9]+"))))
    literal = rules.select("rule", F.explode("literals").alias("token"))
    count = tokens.select("token").join(small(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rank = Window.partitionBy("rule").orderBy(F.coalesce("urls", F.lit(0)), "token")
    filed = literal.join(count, "token", "left").withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("rule", "token")
    filed = filed.join(rules.drop("literals"), "rule")
    fetched = tokens.join(small(filed), "token").where("at rlike regex")
    hits = fetched.select("host", "path", "rule", "by_host", "rule_verdict")
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("by_host"), F.struct(F.length("rule").alias("size"), "rule", "rule_verdict"))).alias("fixed"),
        F.array_sort(F.collect_set(F.when(~F.col("by_host"), F.col("rule")))).alias("patterns"),
        F.max(F.when(~F.col("by_host"), F.col("rule_verdict"))).alias("pattern_verdict"),  # block > allow
    )
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.rule_verdict", "pattern_verdict", F.lit(default)).alias("verdict"), F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))
