"""URL filters: host rules, then pattern rules indexed by literal tokens.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import materialise

# Fixed values: (verdict, host and path prefix).
HOST_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# Default pattern rules: (verdict, pattern), see ``pattern_regex``.
PATTERN_RULES = [
    ("block", "/wp-admin/"),
    ("block", "/wp-login.php"),
    ("block", "/cart/"),
    ("block", "/checkout/"),
    ("block", "/login^"),
    ("block", "/signin^"),
    ("block", "/tag/*/page/"),
    ("block", "/search?*q="),
    ("block", "^replytocom="),
    ("block", "^sessionid="),
    ("block", "^phpsessid="),
    ("block", "^print=1^"),
    ("block", "^utm_source=feed^"),
    ("block", "^ref=x^"),
    ("block", "://m.*.html|"),
    ("block", ".exe|"),
    ("block", ".zip|"),
    ("allow", "/docs/"),
    ("allow", "://blog.*.example.org^"),
]

WORD_CHARS = "a-z0-9"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a url that is null or
    has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict.  A rule fits
    its host and all subdomains if the path starts with the rule's."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def pattern_regex(pattern: str) -> str:
    """Regular expression of a pattern over the A-Z lower-cased url: ``*``
    stands for any run, ``^`` for a separator (none of ``a-z0-9_.%-``) or the
    end, ``|`` first or last for the url's start or end; all else is meant
    literally, anywhere in the url."""
    body = pattern.lower()
    start, end = body.startswith("|"), body.endswith("|") and len(body) > 1
    body = body[start:len(body) - end]
    parts = {"*": r"[\s\S]*", "^": rf"(?:[^{WORD_CHARS}_.%-]|\z)"}
    return "^" * start + "".join(parts.get(c, re.escape(c)) for c in body) + r"\z" * end


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens of a pattern: runs of ``a-z0-9`` that any matching url
    holds as whole tokens, so both neighbours must be literal separators,
    ``^`` or the url's own start or end."""
    body = pattern.lower()
    found = []
    for m in re.finditer(rf"[{WORD_CHARS}]+", body):
        before, after = body[m.start() - 1:m.start()], body[m.end():m.end() + 1]
        if before not in ("", "*") and after not in ("", "*"):
            found.append(m.group())
    return sorted(set(found))


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(rule_id, rule_verdict, pattern, regex, token)``: every token of
    every rule; a rule without tokens has the empty one."""
    rows = [(i, verdict, p, pattern_regex(p), t)
            for i, (verdict, p) in enumerate(rules) for t in pattern_tokens(p) or [""]]
    return pages.sparkSession.createDataFrame(rows, "rule_id int, rule_verdict string, pattern string, regex string, token string")


def url_tokens(urls: DataFrame) -> DataFrame:
    """``(url, token)`` with the distinct tokens of each lower-cased url, the
    empty one included (it fetches the rules that have no token)."""
    tokens = F.array_distinct(F.regexp_extract_all(F.col("url"), F.lit(rf"[{WORD_CHARS}]+"), 0))
    return urls.select("url", F.explode(F.array_append(tokens, F.lit(""))).alias("token"))


def pattern_matches(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(url, pattern_verdict, pattern, n_candidates)`` of the distinct
    lower-cased ``urls`` that some rule was tried on.

    Each rule is indexed by the rarest of its tokens among the urls (ties:
    the smallest); a url fetches the rules indexed under its own tokens and
    only these run.  An allowing rule wins over blocking ones; ``pattern`` is
    the first matching rule of the winning kind, null if none matched.  The
    rules are a parameter; Spark sizes the table and chooses the join.
    """
    table = rule_table(urls, rules)
    tokens = url_tokens(urls)
    counts = tokens.join(table.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (table.join(counts, "token", "left").groupBy("rule_id", "rule_verdict", "pattern", "regex")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
              .select("rule_id", "rule_verdict", "pattern", "regex", F.col("best.token").alias("token")))
    tried = tokens.join(materialise(rarest, "url-rules"), "token").withColumn("hit", F.expr("url rlike regex"))

    def first_of(kind: str) -> Column:
        return F.min(F.when(F.col("hit") & (F.col("rule_verdict") == kind), F.struct("rule_id", "pattern")))

    best = tried.groupBy("url").agg(F.count(F.lit(1)).alias("n_candidates"), first_of("allow").alias("allow"), first_of("block").alias("block"))
    return best.select(
        "url", F.when(F.col("allow").isNull() & F.col("block").isNotNull(), "block").otherwise("allow").alias("pattern_verdict"),
        F.coalesce("allow.pattern", "block.pattern").alias("pattern"), "n_candidates")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                host_rules: Sequence[tuple[str, str]] = HOST_RULES,
                pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    """``(id_col, host, path, rule, verdict, pattern, n_candidates)`` of
    every row of ``pages``.

    ``rule`` is the longest host rule that fits and decides; without one the
    pattern rules do, and what no rule matches is allowed.  A null url has an
    empty host and path, no rule, and is allowed.  Equal urls are judged once
    and every row keeps its own line; other columns do not matter.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("raw"))
    rows = rows.withColumn("low", ascii_lower(F.col("raw")))
    urls = rows.where("low is not null").select(F.col("low").alias("url")).distinct()
    found = materialise(pattern_matches(urls, pattern_rules), "url-matches")
    host, path = host_and_path(F.col("raw"))
    named = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return named.join(found, named["low"] == found["url"], "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, "pattern_verdict", F.lit("allow")).alias("verdict"), "pattern",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
