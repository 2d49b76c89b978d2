"""URL filters: rules found by their rarest literal token, in DataFrame operations.

A rule is a pattern that compiles to one regular expression and to the literal tokens
(runs of a-z and 0-9) that any URL it fits must hold whole. Each rule is indexed under
the token that the fewest URLs hold; a URL's tokens fetch candidate rules, and only
those run their expressions. Rules without such a token are fetched by every URL.

Host rules (``example.net/en/``) fit their host and its subdomains if the path starts
with the rule's; the longest that fits decides. Else the pattern rules do: a URL that
fits a blocking pattern and no allowing one is blocked, all others are allowed.
Patterns are matched against the URL in lower case: ``*`` stands for any text, ``^``
for a separator or the end, a leading ``||`` for the start of a host label.

Work is done once for each distinct URL; pages then look their URL up. A null URL, or
one without ``://``, has empty host and path, fits no host rule, and is allowed unless
a pattern fits. Repeated and null page ids are judged row by row. Other columns are not
looked at. An empty table gives no rows. The rule table is a parameter of the call;
whether it is small enough to send to all executors is left to Spark's size threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatescope.llm.common import lower_ascii, read_table

# The host rules that the query judges by.
HOST_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
PATTERN_RULES = (
    ("block", "||spam-farm.*"),
    ("block", "||ads.*"),
    ("block", "||tracker.*"),
    ("block", "*/adserver/*"),
    ("block", "*/casino^*"),
    ("block", "*/free-download^*"),
    ("allow", "||spam-farm.*/about^*"),
)
RULE_SCHEMA = "rule_id int, kind string, action string, rule string, regex string, tokens array<string>"


def _bounded_tokens(parts: list[tuple[str, bool, bool]]) -> list[str]:
    """Tokens of literal parts (text, closed at the left, closed at the right) that stand whole."""
    found = set()
    for text, left, right in parts:
        for m in re.finditer("[a-z0-9]+", text):
            if (m.start() > 0 or left) and (m.end() < len(text) or right):
                found.add(m.group())
    return sorted(found)


def host_rule(rule: str) -> tuple[str, list[str]]:
    """(expression over host and path, tokens) of a host rule."""
    return r"^([^/]*\.)?" + _quoted(rule), _bounded_tokens([(rule.lower(), True, False)])


def pattern_rule(pattern: str) -> tuple[str, list[str]]:
    """(expression over the lower-case URL, tokens) of a pattern rule."""
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||").lower()
    regex = r"^[^/?#]*://([^/?#]*\.)?" if anchored else ""
    parts, closed = [], anchored
    for piece in re.split(r"([*^])", body):
        if piece == "*":
            regex, closed = regex + r"(.|\n)*", False
        elif piece == "^":
            regex, closed = regex + r"([^a-z0-9_.%-]|$)", True
            if parts:
                parts[-1] = (parts[-1][0], parts[-1][1], True)
        elif piece:
            regex += _quoted(piece)
            parts.append((piece, closed, False))
            closed = False
    return regex, _bounded_tokens(parts)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_\u0080-￿-])", r"\\\1", text)


def compile_rules(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[tuple]:
    rules = []
    for action, text in host_rules:
        rules.append((len(rules), "host", action, text, *host_rule(text)))
    for action, text in pattern_rules:
        rules.append((len(rules), "pattern", action, text, *pattern_rule(text)))
    return rules


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame,
    host_rules=HOST_RULES,
    pattern_rules=PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule (the host rule that decided), verdict."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    urls = rows.select("url").where("url IS NOT NULL").distinct()
    urls = urls.withColumn("plain", F.concat(host, path)).withColumn("lower", lower_ascii(F.col("url")))
    tokens = F.array_distinct(F.regexp_extract_all("lower", F.lit("[a-z0-9]+"), F.lit(0)))
    tokens = urls.withColumn("token", F.explode(F.concat(tokens, F.array(F.lit("")))))
    rules = spark.createDataFrame(compile_rules(host_rules, pattern_rules), RULE_SCHEMA)
    # The empty token stands for "every URL", under which rules without tokens are found.
    literal = rules.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    held = tokens.select("token").join(literal.select("token").distinct(), "token").groupBy("token").count()
    rarest = Window.partitionBy("rule_id").orderBy(F.coalesce("count", F.lit(0)), "token")
    index = (
        literal.join(held, "token", "left")
        .withColumn("nth", F.row_number().over(rarest))
        .where("nth = 1")
        .select("rule_id", "token")
        .join(rules.drop("tokens"), "rule_id")
    )
    fits = F.expr("CASE WHEN kind = 'host' THEN plain RLIKE regex ELSE lower RLIKE regex END")
    of_kind = lambda kind, action: F.max((F.col("kind") == kind) & (F.col("action") == action))
    longest = F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("n"), "rule", "action")))
    judged = (
        tokens.join(index, "token")
        .where(fits)
        .groupBy(F.col("url").alias("of_url"))
        .agg(
            longest.alias("longest"),
            of_kind("pattern", "block").alias("blocked"),
            of_kind("pattern", "allow").alias("allowed"),
        )
    )
    by_pattern = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return rows.join(judged, F.col("url") == F.col("of_url"), "left").select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.col("longest.rule").alias("rule"),
        F.coalesce("longest.action", by_pattern).alias("verdict"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged."""
    return judge_urls(read_table(spark, sf_dir, "pages"))


def _sql() -> str:
    rules = ",\n  ".join(
        "('{}', '{}', '{}', '{}')".format(kind, action, rule, regex)
        for _, kind, action, rule, regex, _ in compile_rules()
    )
    return rf"""
WITH rules(kind, action, rule, regex) AS (VALUES
  {rules}),
split AS (SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS nr, page_id,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
fits AS (SELECT nr, kind, action, rule FROM parts, rules
  WHERE regexp_matches(CASE WHEN kind = 'host' THEN host || path ELSE lower END, regex)),
judged AS (SELECT nr, max((length(rule), rule, action)) FILTER (kind = 'host') AS longest,
    bool_or(kind = 'pattern' AND action = 'block') AND NOT bool_or(kind = 'pattern' AND action = 'allow') AS blocked
  FROM fits GROUP BY nr)
SELECT page_id, host, path, longest[2] AS rule,
  coalesce(longest[3], CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN judged USING (nr)
"""


OP5_SQL = _sql()
