"""URL filters by host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits a URL of its host or a subdomain whose path starts with the
rule's path; the longest rule string wins, and of equal strings, block.  Each URL is expanded
into its host suffixes and path prefixes; an expression is host suffix + path up to a slash.
Rules are keyed the same way (host + the path up to its last slash).  URLs and rules meet in
an equi-join on the first PREFIX_BITS of the expression's SHA-256, then the full digest and
the rest of the rule's path are confirmed and the longest rule is taken.

The verdict of a pair that more than one row in HOT_SHARE has (no more than HOT_SHARE pairs do)
is broadcast; those of the others come back by shuffle, in which rows without a host take no part.

Suffixes have no more labels, and prefixes no more slashes, than the longest rule has; that
loses nothing, as longer ones equal no rule.  Distinct (host, path) pairs are judged once, so
a common host or page costs one row.  A rule list of up to ``broadcast_rules`` rows is
broadcast; a longer one joins by shuffle, after a semi-join with the prefixes in use.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule
fits, and gets the default verdict; an empty host fits nothing; rules with a null host, path
or verdict are left out; repeated rows are judged as often as they come; empty tables give no
rows, an empty rule list gives the default to all; columns other than id and URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

PREFIX_BITS = 32
BROADCAST_RULES = 100_000
HOT_SHARE = 100
#: The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BITS // 4)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; ``rules`` has host, path, verdict."""
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.where("host is not null and host <> '' and path is not null and verdict is not null").select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.lower("verdict").alias("r_verdict"))
    base = F.expr("left(r_path, length(r_path) - coalesce(nullif(locate('/', reverse(r_path)), 0), length(r_path) + 1) + 1)")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block comes after allow
    rules = rules.withColumn("r_digest", _digest(F.concat("r_host", base))).withColumn("key", _prefix(F.col("r_digest")))
    size, labels, slashes = rules.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit(""))))).first()

    urls = pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("rows"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.expr(f"transform(sequence(1, least(size(labels), {labels or 1})), i -> array_join(slice(labels, -i, i), '.'))")
    # The path up to each of its first slashes, and the empty one, for rules without a slash.
    prefixes = F.expr(f"transform(sequence(0, least(size(steps) - 1, {slashes or 0})), i -> if(i = 0, '', concat(array_join(slice(steps, 1, i), '/'), '/')))")
    wide = urls.withColumn("labels", parts).withColumn("steps", F.split("path", "/", -1))
    wide = wide.select("host", "path", "rows", F.explode(suffixes).alias("s"), prefixes.alias("p")).select("host", "path", "rows", F.explode("p").alias("p"), "s")
    wide = wide.withColumn("digest", _digest(F.concat("s", "p"))).withColumn("key", _prefix(F.col("digest")))
    if size <= broadcast_rules:
        rules = F.broadcast(rules)
    else:
        rules = rules.join(wide.select("key").distinct(), "key", "left_semi")
    fit = wide.join(rules, "key").where("digest = r_digest and s = r_host and startswith(path, r_path)")
    rule = F.concat("r_host", "r_path")
    best = fit.groupBy("host", "path").agg(F.max("rows").alias("rows"), F.max(F.struct(F.length(rule).alias("n"), "r_verdict", rule.alias("rule"))).alias("best"))
    found = materialize(best.select(F.col("host").alias("h"), F.col("path").alias("p"), "rows", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict")), "verdicts")
    is_hot = F.col("rows") * HOT_SHARE > pages.count()
    hot = F.broadcast(found.where(is_hot).select(F.col("h").alias("hot_h"), F.col("p").alias("hot_p"), F.col("rule").alias("hot_rule"), F.col("verdict").alias("hot_verdict")))
    out = pages.join(hot, (F.col("host") == F.col("hot_h")) & (F.col("path") == F.col("hot_p")), "left")
    # Rows that need no partner are dealt by their ids.
    asks = (F.col("host") != "") & F.col("hot_h").isNull()
    out = out.withColumn("ask_h", F.when(asks, F.col("host"))).withColumn("ask_p", F.when(asks, F.col("path")).otherwise(F.xxhash64("page_id").cast("string")))
    out = out.join(found.where(~is_hot), (F.col("ask_h") == F.col("h")) & (F.col("ask_p") == F.col("p")), "left")
    return out.select("page_id", "host", "path", F.coalesce("rule", "hot_rule").alias("rule"), F.coalesce("verdict", "hot_verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
v AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
w AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM v)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM w
"""
