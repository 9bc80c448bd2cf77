"""URL filters by host-suffix and path-prefix expressions, with DataFrame operations alone.

Each URL is expanded into its expressions: every suffix of its host at a dot that has as many labels as some rule's host, with
every prefix of its path that is as long as some rule's path; so a URL's work follows the rules, however many labels its host
has. A rule fits exactly the URLs that have its own text among their expressions. The
expressions join the rules on the first bytes of a SHA-256 digest; the full digest confirms, and the longest rule wins.

Rules are a list that the user states, so their table is broadcast up to BROADCAST_RULES rows and BROADCAST_BYTES, and joined
by a shuffle beyond. Only page_id and url are read, once; a page's expressions are put together where they were made.

Defined results: null URLs and URLs without "://" have an empty host and path and no rule; without a rule the
verdict is `default`; of equally long rules the first as text wins; repeated rows each get their verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoweave.session import table

SHORT = 8  # hexadecimal digits of the digest that the join uses
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 8 << 20
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The expressions of a URL, for rule hosts of the given numbers of labels and rule paths of the given lengths."""
    suffixes = F.array_distinct(F.array(*(F.substring_index(host, ".", -n) for n in labels)))  # a host of fewer labels is its own
    prefixes = F.array_compact(F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`. rules: verdict, host, path."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths, labels = sorted({len(p) for _, _, p in rules}), sorted({h.count(".") + 1 for _, h, _ in rules})
    order = sorted({(h + p, v) for v, h, p in rules}, key=lambda r: (-len(r[0]), *r))  # the first that fits wins
    listed = spark.createDataFrame([(k, *r) for k, r in enumerate(order)], "place int, rule string, verdict string")
    digests = listed.select("place", F.sha2("rule", 256).alias("_digest")).withColumn("_short", F.substring("_digest", 1, SHORT))
    few = len(rules) <= BROADCAST_RULES and sum(len(h) + len(p) for _, h, p in rules) <= BROADCAST_BYTES
    small = F.broadcast if few else (lambda df: df)
    # Every row keeps a number of its own, so that equal URLs and pages never meet in one group.
    asked = rows.withColumn("_row", F.monotonically_increasing_id())
    asked = asked.select("_row", "page_id", "host", "path", F.explode_outer(F.when(F.col("_url").contains("://"), expressions(F.col("host"), F.col("path"), labels, lengths))).alias("_text"))
    asked = asked.withColumn("_asked", F.sha2("_text", 256)).withColumn("_short", F.substring("_asked", 1, SHORT))
    hits = asked.join(small(digests), "_short", "left")
    place = F.min(F.when(F.col("_asked") == F.col("_digest"), F.col("place")))
    best = hits.groupBy("_row", "page_id", "host", "path").agg(place.alias("place"))
    found = best.join(small(listed), "place", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated rules over every URL of `pages`."""
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLE_SQL = {
    "op9_url_filters": r"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
     ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
     coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hits AS (SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
         FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hits ON hits.page_id = u.page_id AND place = 1"""
}
