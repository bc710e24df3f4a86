r"""URL filter: pattern rules indexed by their rarest literal token.

A rule list can be long, so no URL is run against all of it. Every rule names a regular expression and the literal
tokens (runs of ``[a-z0-9]``) that any URL it fits must hold. The index keeps each rule under one of them: the token
that the fewest URLs hold, counted over all URLs. A URL's distinct tokens fetch candidate rules by an equi-join, and
only these run their regular expressions.

The method's own rules are made from words that tell of a kind of host: as a whole token, glued to a common affix, or as
two tokens in a row. They know no host of their own.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Salted, Scratch


class Rule(NamedTuple):
    """``verdict`` for URLs whose canonical form ``host/path`` fits ``pattern``; ``tokens`` are its literals.

    Host rules rank above the others; the longest host rule wins.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for a host with all its subdomains and paths that start with ``path`` (``/``: any, even an empty one)."""
    rest = "" if path == "/" else re.escape(path)
    name = host + path
    return Rule(name, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}(?:\z|(?=[/?#])){rest}", tuple(re.findall("[a-z0-9]+", host)), 1000 + len(name))


def token_rule(verdict: str, kind: str, *tokens: str) -> Rule:
    """A rule for hosts that hold ``tokens`` one after the other, whatever stands between them but letters and digits."""
    return Rule(f"{kind}: {' '.join(tokens)}", verdict, rf"^(?:[^/?#]*[^a-z0-9/?#])?{'[^a-z0-9/?#]+'.join(tokens)}(?:[^a-z0-9]|\z)", tokens, 0)


#: The stated host rules.
HOST_RULES = (host_rule("block", "net"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"))
#: Words that tell of a host's kind, each a whole token of the host; affixes that they are glued to; and pairs of tokens
#: of which one alone tells nothing (fixed values).
KINDS = {
    "gambling": "bet bets betting bookmaker casino casinos gambling jackpot poker roulette slots",
    "adverts": "ads adserver adserving adverts popads track tracker tracking telemetry",
    "adult": "adult camgirls escorts hentai porn porno sex xxx",
    "pharmacy": "cialis levitra pills viagra xanax",
    "link farms": "backlinks linkfarm linkfarms seolinks spam spammer",
}
PREFIXES, SUFFIXES = "online free best live my top buy", "online bonus club shop world hub live"
PAIRS = {
    "gambling": "free spins/live dealer/sports odds/win cash/no deposit",
    "adverts": "ad server/click tracker/pixel collect",
    "adult": "live cams/hot singles",
    "pharmacy": "cheap meds/no prescription/rx discount",
    "link farms": "link exchange/buy links/buy followers/seo links",
}
KIND_RULES = tuple(
    token_rule("block", kind, *tokens)
    for kind, words in KINDS.items()
    for tokens in [*((t,) for w in words.split() for t in (w, *(p + w for p in PREFIXES.split()), *(w + s for s in SUFFIXES.split()))), *(p.split() for p in PAIRS[kind].split("/"))]
)
RULES = HOST_RULES + KIND_RULES
#: The most rules that every task gets whole; more are joined by shuffle.
MOST_SENT = 10_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), 0))


def rule_index(spark, rules: tuple[Rule, ...], tokens: DataFrame) -> DataFrame:
    """Rules, each under its rarest token by the count of ``tokens`` (one row a URL and distinct token)."""
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
    listed = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.rank, list(r.tokens)) for r in rules], schema)
    held = listed.select("rule", "verdict", "pattern", "rank", F.explode("tokens").alias("token"))
    wanted = held.select("token").distinct()
    counts = tokens.join(_sent(wanted, rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return held.join(counts, "token", "left").groupBy("rule", "verdict", "pattern", "rank").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def _sent(of_rules: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return F.broadcast(of_rules) if len(rules) <= MOST_SENT else of_rules


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the pattern rule ``pattern_rule`` for each row of ``pages``.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and get ``default``. URLs are read whole,
    however long. Repeated rows are each judged, a null page_id stays null, and columns other than page_id and url are
    not used. The highest rank wins, equal ranks go to the smaller name. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col("url").cast("string"))
    slim = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("address", F.concat("host", "path"))
    # rules see only what they fit: equal addresses are judged once, and a hot host is one row for each path
    addresses = scratch.write(slim.groupBy("address").agg(F.count("*").alias("m")), "addresses")
    tokens = addresses.select("address", F.explode(tokens_of(F.col("address"))).alias("token"))
    index = rule_index(pages.sparkSession, rules, tokens)
    fits = tokens.join(_sent(index, rules), "token").where(F.expr("address rlike pattern"))
    best = fits.groupBy("address").agg(F.min_by(F.struct("rule", "verdict", "rank"), F.struct(-F.col("rank"), "rule")).alias("best"))
    # addresses that many pages share have their pages dealt out to several tasks
    total = addresses.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    judged = Salted(addresses, ["address"], total).join(slim, "page_id", best, how="left")
    is_host = F.coalesce(F.col("best.rank") > 0, F.lit(False))
    return judged.select("page_id", "host", "path", F.when(is_host, F.col("best.rule")).alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), F.when(~is_host, F.col("best.rule")).alias("pattern_rule"))


def _values(of: dict[str, str], parts: str) -> str:
    return ", ".join(f"('{k}', '{x}')" for k, text in of.items() for x in text.split(parts))


ORACLE = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT h.page_id, h.host, h.path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS rn
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND (rule_path = '/' OR starts_with(path, rule_path))),
words(kind, word) AS (VALUES {_values(KINDS, " ")}),
pairs(kind, word) AS (VALUES {_values(PAIRS, "/")}),
own AS (
  SELECT kind, word FROM words UNION ALL SELECT kind, word FROM pairs
  UNION ALL SELECT kind, unnest(string_split('{PREFIXES}', ' ')) || word FROM words
  UNION ALL SELECT kind, word || unnest(string_split('{SUFFIXES}', ' ')) FROM words),
-- a host's tokens in order, so that a rule's tokens are a part of them
t AS (SELECT host, ' ' || array_to_string(regexp_extract_all(host, '[a-z0-9]+'), ' ') || ' ' AS tokens FROM (SELECT DISTINCT host FROM h)),
k AS (SELECT host, min(kind || ': ' || word) AS pattern_rule FROM t JOIN own ON contains(tokens, ' ' || word || ' ') GROUP BY host)
SELECT page_id, f.host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern_rule END AS pattern_rule
FROM f LEFT JOIN k ON f.host = k.host WHERE rn = 1
"""
