"""URL filters: rules indexed by their rarest literal token, so that few regular expressions run.

A host rule, ``host/path``, fits that host and its subdomains where the path starts with the rule's.
A pattern rule is text in which ``*`` is any run of characters, ``^`` a separator or the end, and
``||`` at the start the beginning of a host's label; it fits anywhere in the lower-cased URL.
The index is an array of buckets of tokens that every task holds: a URL's tokens look up their
buckets within the row, so judging shuffles nothing. More rules than a task should hold are joined
by token instead. DataFrame functions only.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_HELD_RULES = 10_000  #: that every task holds; more are joined by their tokens
MAX_BROADCAST_RULES = 100_000  #: more rules are joined by shuffle
#: (host rule, action)
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: (pattern, action); a pattern that allows goes before one that blocks
PATTERNS = (
    ("||casino-", "block"),
    ("||free-bets.", "block"),
    ("||cheap-pills.", "block"),
    ("/login^", "block"),
    ("/signup^", "block"),
    ("/cart^", "block"),
    ("/ads/", "block"),
    ("^utm_source=spam^", "block"),
    ("/wiki/", "allow"),
)


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", text)


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    is_host: bool
    regex: str
    tokens: tuple[str, ...]  #: literals that are whole tokens in every URL the rule fits


def host_rule(text: str, action: str) -> Rule:
    host, slash, path = text.partition("/")
    runs = [m for m in re.finditer(r"[a-z0-9]+", text.lower())]
    whole = tuple(m[0] for m in runs if m.end() < len(text))
    return Rule(text, action, True, r"^(?:[^/]*\.)?" + _literal(host.lower()) + _literal(slash + path), whole)


def pattern_rule(text: str, action: str) -> Rule:
    body = text.lower().removeprefix("||")
    anchored = body != text.lower()
    parts = {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    regex = "".join(parts.get(c, _literal(c)) for c in body)
    whole = tuple(m[0] for m in re.finditer(r"[a-z0-9]+", body) if (m.start() > 0 and body[m.start() - 1] != "*" or anchored and m.start() == 0) and m.end() < len(body) and body[m.end()] != "*")
    return Rule(text, action, False, (r"://(?:[^/?#]*[.@])?" if anchored else "") + regex, whole)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, host_rules: tuple[tuple[str, str], ...] = HOST_RULES, patterns: tuple[tuple[str, str], ...] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``url_col``, ``host``, ``path``, ``rule`` (the longest host rule that fits, else null), ``verdict``.

    The verdict is that rule's; else allow where a pattern that allows fits, block where one that
    blocks does, and allow. One row per input row, null ids and repeated rows included; a null URL
    or one without ``://`` has an empty host and path and fits no host rule. Other columns are
    ignored, so names can't clash. Without rules everything is allowed.
    """
    rules = sorted({host_rule(*r) for r in host_rules}, key=lambda r: (len(r.text), len(r.text.partition("/")[0]), r.text)) + sorted({pattern_rule(*p) for p in patterns}, key=lambda r: (r.action == "allow", r.text))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    named = _judged_in_rows(urls, rules) if len(rules) <= MAX_HELD_RULES else _judged_by_join(urls, rules)
    verdict = F.coalesce("action", F.when(~F.col("allowed") & F.col("blocked"), "block").otherwise("allow"))
    return named.select(F.col("id").alias(id_col), F.col("url").alias(url_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"))


def _tokens(url: str) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(F.translate(url, UPPER, LOWER), F.lit("")), "[^a-z0-9]+")), lambda t: t != "")


def _subject(is_host: Column) -> Column:
    """What a rule's expression is tried on: host and path, or the whole lower-cased URL."""
    return F.when(is_host, F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.translate("url", UPPER, LOWER))


def _judged_in_rows(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, url, rule, action, allowed, blocked); the driver gets how many URLs use each of the rules' literals."""
    literals = sorted({t for r in rules for t in r.tokens})
    wanted = F.from_json(F.lit(json.dumps(literals)), "array<string>")
    used = urls.select(F.explode(F.array_intersect(_tokens("url"), wanted)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses")) if literals else None
    uses = {r.token: r.uses for r in used.collect()} if used is not None else {}  # at most a row a literal
    width = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(width)]
    free = []
    for rank, r in enumerate(rules):
        item = {"rank": rank, "rule": r.text, "action": r.action, "is_host": r.is_host, "regex": r.regex}
        if r.tokens:
            token = min(r.tokens, key=lambda t: (uses.get(t, 0), t))
            buckets[zlib.crc32(token.encode()) % width].append({"token": token, **item})
        else:
            free.append({"token": "", **item})  # a rule without a literal is tried on every URL
    kind = "struct<token: string, rank: int, rule: string, action: string, is_host: boolean, regex: string>"
    held = lambda value, ddl: F.from_json(F.lit(json.dumps(value)), ddl)  # noqa: E731  a constant of the plan
    fetched = lambda t: F.filter(F.element_at(held(buckets, f"array<array<{kind}>>"), (F.crc32(t.cast("binary")) % width + 1).cast("int")), lambda r: r["token"] == t)
    candidates = F.concat(held(free, f"array<{kind}>"), F.flatten(F.transform(_tokens("url"), fetched)))
    whole = F.coalesce(F.col("url").contains("://"), F.lit(False))
    rows = urls.withColumn("fetched", F.when(whole, candidates).otherwise(F.array().cast(f"array<{kind}>")))
    rows = rows.withColumn("at", F.when(F.size("fetched") > 0, F.struct(_subject(F.lit(True)).alias("host"), _subject(F.lit(False)).alias("url"))))
    rows = rows.withColumn("fits", F.filter("fetched", lambda r: F.regexp_like(F.when(r["is_host"], F.col("at.host")).otherwise(F.col("at.url")), r["regex"])))
    longest = F.array_max(F.transform(F.filter("fits", lambda r: r["is_host"]), lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["action"].alias("action"))))
    some = lambda action: F.exists("fits", lambda r: ~r["is_host"] & (r["action"] == action))
    return rows.select("id", "url", some("allow").alias("allowed"), some("block").alias("blocked"), longest.alias("best")).select("id", "url", "best.rule", "best.action", "allowed", "blocked")


def _judged_by_join(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same with the rules as a table that meets the URLs' tokens."""
    spark = urls.sparkSession
    listed = [(k + 1, r.text, r.action, r.is_host, r.regex) for k, r in enumerate(rules)]
    table = spark.createDataFrame(listed, "rank int, rule string, action string, is_host boolean, regex string")
    literals = spark.createDataFrame([(k + 1, t) for k, r in enumerate(rules) for t in sorted(set(r.tokens)) or [""]], "rank int, token string")
    small = F.broadcast if len(rules) <= MAX_BROADCAST_RULES else (lambda df: df)

    tokens = _tokens("url")
    # the empty token stands for the row itself and fetches rules without a literal
    spread = urls.select("id", "url", F.explode(F.concat(F.array(F.lit("")), tokens)).alias("token"))

    used = spread.where("token <> ''").join(small(literals.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rarest = Window.partitionBy("rank").orderBy(F.coalesce("uses", F.lit(0)), "token")
    index = literals.join(small(used), "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1").select("rank", "token")
    index = index.join(small(table), "rank").select("token", "rank", "action", "is_host", "regex")

    fetched = spread.join(small(index), "token", "left").where("token = '' OR rank IS NOT NULL")
    fits = F.coalesce(F.regexp_like(_subject(F.col("is_host")), F.col("regex")) & F.col("url").contains("://"), F.lit(False))
    hit = fetched.select("id", "url", (F.col("token") == "").alias("row"), "rank", F.when(F.col("rank").isNotNull() & fits, F.when(F.col("is_host"), 0).when(F.col("action") == "allow", 1).otherwise(2)).alias("hit"))
    judged = hit.groupBy("id", "url").agg(
        F.count(F.lit(1)).alias("found"),
        F.countDistinct(F.when(F.col("row"), F.coalesce("rank", F.lit(0)))).alias("free") if any(not r.tokens for r in rules) else F.lit(1).alias("free"),
        F.count_if("row").alias("rows"),
        F.max(F.when(F.col("hit") == 0, F.col("rank"))).alias("rank"),
        F.bool_or(F.coalesce(F.col("hit") == 1, F.lit(False))).alias("allowed"),
        F.bool_or(F.coalesce(F.col("hit") == 2, F.lit(False))).alias("blocked"),
    )
    judged = judged.select("id", "url", "rank", "allowed", "blocked", F.explode(F.array_repeat(F.lit(0), (F.col("rows") / F.col("free")).cast("int"))))
    return judged.join(small(table.select("rank", "rule", "action")), "rank", "left")
