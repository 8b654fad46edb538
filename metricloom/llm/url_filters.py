"""URL rules indexed by their rarest literal token (operator 3).

A rule is a regular expression with the literal tokens that any URL it matches
must hold.  One aggregation counts the rules' tokens over all URLs; each rule
is filed under its rarest, one without tokens under a token that every URL has.
The tokens of the distinct URLs join the index and fetch candidate rules, and
only those run their expression.  The index is a table, and there is one way
for any number of rules; keys that many rows share, null URLs among them, are
dealt over all tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matched, small, written

#: Bytes of a filed rule, for the size of the index.
RULE_BYTES = 400


@dataclass(frozen=True)
class Rule:
    """weight: the heaviest match wins, then the least name.  A host rule's is
    its length over 0; a pattern rule's is negative, so that it speaks only
    where no host rule does."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    closed = path[: path.rindex("/") + 1] if "/" in path else ""
    tokens = [t for t in re.split("[^a-z0-9]+", f"{host} {closed}".lower()) if t]
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)} {re.escape(path)}", tuple(tokens), len(host + path))


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """``pattern`` runs on ``host path`` (a space between them, lower case host)."""
    return Rule(name, verdict, pattern, tokens, -1)


HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
# fixed values: words of hosts that sell bets, adult content, pills, loans or
# copies, or that serve advertisements
HOST_WORDS = (
    "adserver", "ads", "adult", "baccarat", "banner", "bet", "bets", "betting", "bingo", "blackjack", "bookmaker", "cams", "casino", "cialis", "click",
    "clickbait", "crack", "cracks", "dating", "escort", "gambling", "jackpot", "keygen", "loans", "lottery", "malware", "nude", "payday", "phishing",
    "pills", "poker", "popunder", "popup", "porn", "roulette", "serial", "sex", "slots", "spam", "sportsbet", "sweepstakes", "torrent", "torrents", "track",
    "tracker", "tracking", "viagra", "warez", "webcam", "xxx",
)
#: Path segments of pages without prose.
PATH_WORDS = ("cart", "checkout", "login", "logout", "password", "register", "signin", "signup", "wp-login.php", "xmlrpc.php")
PATTERN_RULES = (
    *(pattern_rule(f"host:{w}", "block", rf"\A(?:[^ ]*[.-])?{w}[.-]", w) for w in HOST_WORDS),
    *(pattern_rule(f"path:{w}", "block", rf" (?:/[^ ]*)?/{re.escape(w)}(?:/|\z)", *re.split("[^a-z0-9]+", w)) for w in PATH_WORDS),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)
    return host, F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(name, verdict, pattern, tokens, weight) of the rules."""
    text = json.dumps([{"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "tokens": sorted(set(r.tokens)), "weight": r.weight} for r in rules])
    kind = "array<struct<name: string, verdict: string, pattern: string, tokens: array<string>, weight: int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def _tokens(host: Column, path: Column) -> Column:
    """The tokens of a URL, the empty one too."""
    return F.array_distinct(F.concat(F.split(F.lower(F.concat_ws(" ", host, path)), "[^a-z0-9]+"), F.array(F.lit(""))))


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rules, rows): the rules under the token that is rarest among the
    ``urls`` (token, a row for each of a URL), the least among equals; rows: the
    URLs that have it."""
    rules = written(rules.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))), "rules")
    known = written(rules.select(F.explode("tokens").alias("token")).distinct(), "vocabulary")
    counts = written(urls.join(small(known, 40), "token", "left_semi").groupBy("token").agg(F.count("*").alias("rows")), "counts")
    each = rules.withColumn("token", F.explode("tokens")).join(small(counts, 40), "token", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    columns = ["name", "verdict", "pattern", "weight"]
    rarest = each.groupBy(*columns).agg(F.min(F.struct("rows", "token")).alias("at"))
    # rules of one token: as many as the rules' author wrote for it
    index = rarest.groupBy(F.col("at.token").alias("token"), F.col("at.rows").alias("rows")).agg(F.collect_list(F.struct(*columns)).alias("rules"))
    return written(index, "index")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = HOST_RULES + PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the name of the host rule that decides,
    else null) and verdict (the rule's, else a pattern rule's, else
    ``default``); columns of these names are replaced.

    ``rules``: Rule objects or a table as of ``rule_table``; none at all leaves
    every verdict at ``default``.  A null url or one without ``://`` has an empty
    host and path, which no host rule fits.  Rows are judged one by one: ids may
    repeat or be null."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    subjects = written(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "subjects")
    tokens = subjects.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    index = filed(tokens.select("token"), rules)
    candidates = matched(tokens, index, ["token"], RULE_BYTES, "rows", F.xxhash64("host", "path"), "inner")
    fits = F.filter("rules", lambda r: F.rlike(F.concat_ws(" ", F.col("host"), F.col("path")), r["pattern"]))
    heaviest = F.array_min(F.transform(fits, lambda r: F.struct((-r["weight"]).alias("after"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    best = candidates.select("host", "path", "pages", heaviest.alias("best")).filter("best is not null")
    best = written(best.groupBy("host", "path").agg(F.min("best").alias("best"), F.first("pages").alias("pages")), "best")
    judged = matched(rows, best, ["host", "path"], 250, "pages", F.monotonically_increasing_id())
    rule = F.when(F.col("best.after") <= 0, F.col("best.name"))
    return judged.select(*kept, "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for the query, from the same rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    by_weight = sorted(HOST_RULES, key=lambda r: (-r.weight, r.name))
    when = " ".join(f"WHEN regexp_matches(subject, {quote(r.pattern)}) THEN {quote(r.name)}" for r in by_weight)
    verdict = " ".join(f"WHEN rule = {quote(r.name)} THEN {quote(r.verdict)}" for r in HOST_RULES)
    other = " ".join(f"WHEN regexp_matches(subject, {quote(r.pattern)}) THEN {quote(r.verdict)}" for r in PATTERN_RULES)
    return f"""WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 ruled AS (SELECT *, host || ' ' || path AS subject, CASE {when} END AS rule FROM (SELECT *, host || ' ' || path AS subject FROM parts) AS p)
SELECT page_id, host, path, rule, CASE {verdict} {other} ELSE 'allow' END AS verdict FROM ruled""".replace("SELECT *, host || ' ' || path AS subject, CASE", "SELECT *, CASE")
