"""Allow and block rules over URLs, found by hash prefixes of host-suffix and path-prefix expressions.

Every URL is expanded into its host suffixes (`a.b.c`, `b.c`, `c`) times the path prefixes that end in `/`. Expressions
meet the rules in an equi-join on the first bytes of their SHA-256 digest; the whole digest confirms a match, so a
shared short prefix does no harm. Of the rules that fit, the longest wins.

Expressions deeper than the deepest rule cannot fit any rule and are not made, so a URL with thousands of segments costs
no more than a short one. The rule table may be of any size: no side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import ascii_lower

PREFIX_BYTES = 4


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or where `://` is missing."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or where `://` is missing."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> list[Column]:
    d = F.sha2(F.encode(expression, "UTF-8"), 256)
    return [F.conv(F.substring(d, 1, 2 * PREFIX_BYTES), 16, 10).cast("long").alias("short"), d.alias("digest")]


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (rule, verdict) as digests. A rule is a host followed by a path that starts and ends with `/`.

    Null rules are left out, equal rules count once, and of a rule with both verdicts block counts.
    """
    r = rules.select(ascii_lower(F.regexp_extract("rule", r"^([^/]*)", 1)).alias("h"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("p"), "verdict").filter("rule is not null")
    r = r.select("h", F.when(r.p.endswith("/"), r.p).otherwise(F.raise_error(F.concat(F.lit("a rule's path must end with /: "), "p"))).alias("p"), "verdict")
    text = F.concat("h", "p")
    return r.groupBy("h", "p").agg(F.max("verdict").alias("verdict")).select(text.alias("rule"), "verdict", *_digest(text), F.size(F.split("h", r"\.")).alias("labels"), F.size(F.split("p", "/")).alias("segments"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict of every row; `default` where no rule fits.

    Input rows are kept as they are, repeated keys too: each distinct (host, path) is judged once and joined back. Null
    and malformed URLs have an empty host and path and get the default; an empty table gives an empty result. Other
    columns of `urls` are left out. Of rules of equal length the one with the longer host wins.
    """
    pages = urls.select(F.col(key).alias("_key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    table = rule_table(rules)
    depth = table.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("max_labels"), F.coalesce(F.max("segments"), F.lit(0)).alias("max_segments"))
    labels = F.split("host", r"\.")
    # only the directories of a path make a difference, so pages of one directory are judged once
    sites = pages.select("host", F.regexp_extract("path", r"(?s)^(.*/)", 1).alias("dir")).distinct().filter("dir <> ''")
    bounded = sites.crossJoin(F.broadcast(depth)).withColumns({"labels": labels, "parts": F.split("dir", "/")})  # one row
    suffixes = "transform(sequence(greatest(1, size(labels) - max_labels + 1), size(labels)), i -> concat_ws('.', slice(labels, i, size(labels) - i + 1)))"
    prefixes = "transform(sequence(1, least(size(parts) - 1, greatest(max_segments - 1, 1))), i -> concat(concat_ws('/', slice(parts, 1, i)), '/'))"
    expanded = bounded.select("host", "dir", F.explode(F.expr(suffixes)).alias("h"), F.expr(prefixes).alias("ps")).select("host", "dir", "h", F.explode("ps").alias("p")).select("host", "dir", F.length("h").alias("host_length"), F.concat("h", "p").alias("expression"))
    hits = (
        expanded.select("host", "dir", "host_length", F.length("expression").alias("length"), *_digest(F.col("expression")))
        .join(table.select("short", F.col("digest").alias("rule_digest"), "rule", "verdict"), "short")
        .filter("digest = rule_digest")
        .groupBy("host", "dir")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct("length", "host_length")).alias("hit"))
    )
    judged = pages.withColumn("dir", F.regexp_extract("path", r"(?s)^(.*/)", 1)).join(hits, ["host", "dir"], "left")
    return judged.select(F.col("_key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
