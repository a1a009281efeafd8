"""Empirical-Bayes host reputation (DataFrame functions only).

Pages whose verdict is known label their hosts. A host's blocked rate has a beta prior whose mean is the posterior mean
of its registered domain, which shrinks towards its suffix, which shrinks towards all pages. The strength of each
prior is estimated from how much the children of one parent differ (moments of the beta-binomial). A host is
blocked if a lower bound of its posterior passes the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

Z = 1.645  # lower 5 % bound by the normal law
LIMIT = 0.5
LEAST, MOST = 0.001, 0.999  # range of the correlation of pages of one host

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column, second_level: tuple[str, ...] = ("co", "com", "org", "net", "ac", "gov")) -> Column:
    """The last two labels, or three under a two-letter country code with one of these second levels."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    country = (F.length(F.element_at(labels, -1)) == 2) & (F.size(labels) > 2) & F.element_at(labels, -2).isin(*second_level)
    return F.when(country, F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, NULL if none does. Rules are a parameter of the query."""
    rule = verdict = F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def strength(children: DataFrame) -> Column:
    """Prior strength from (n, bad, prior) rows: of n pages with mean m, sum n (p - m)^2 is m (1 - m) (1 + (n - 1) r)
    on average, where r is the correlation of pages of one child; the strength is (1 - r) / r. Without children of two
    pages or without variation r is one half."""
    m, p = F.col("prior"), F.col("bad") / F.col("n")
    seen = children.where(F.col("n") > 0).agg(
        F.sum(F.col("n") * (p - m) * (p - m)).alias("spread"), F.sum(m * (1 - m)).alias("one"), F.sum(m * (1 - m) * (F.col("n") - 1)).alias("more"),
    )
    r = F.when(F.col("more") > 0, (F.col("spread") - F.col("one")) / F.col("more")).otherwise(0.5)
    r = F.least(F.greatest(r, F.lit(LEAST)), F.lit(MOST))
    return seen.select(((1 - r) / r).alias("strength")).scalar()


def reputation(labelled: DataFrame) -> DataFrame:
    """Beta posterior of each host from rows (host, blocked), where NULL `blocked` only names a host.

    Returns host, n, rate (posterior mean) and bound (lower bound). One hot host is summed on the map side.
    """
    counts = [F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad")]
    hosts = stage(labelled.groupBy("host").agg(*counts))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", F.substring_index("host", ".", -1))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains, suffixes = hosts.groupBy("suffix", "domain").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    overall = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m")).scalar()

    def shrunk(children: DataFrame) -> DataFrame:
        s = stage(children.withColumn("s", strength(children)))
        return s.withColumn("rate", (F.col("bad") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s")))

    def under(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
        return children.join(parents.select(*on, F.col("rate").alias("prior")), on)

    top = shrunk(suffixes.withColumn("prior", overall))
    middle = shrunk(under(domains, top, ["suffix"]))
    low = shrunk(under(hosts, middle, ["suffix", "domain"]))
    size = F.col("n") + F.col("s")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return low.select("host", "n", "rate", (F.col("rate") - Z * spread).alias("bound"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    Pages that a rule fits get its verdict and are the labelled outcomes; all others get their host's. NULL urls and
    urls without `://` have empty host and path and share one reputation. Repeated rows are judged alike and each
    counts; an empty table gives an empty result. Other columns are not read.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = stage(parts.withColumn("rule", rule).withColumn("known", verdict))
    known = rows.where(F.col("known").isNotNull())
    unknown = rows.where(F.col("known").isNull())
    hosts = reputation(rows.select("host", F.when(F.col("known").isNotNull(), (F.col("known") == "block").cast("int")).alias("blocked")))
    hosts = stage(hosts.select("host", (F.col("bound") > LIMIT).alias("blocked")))
    judged = unknown.join(hosts, "host").withColumn("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    return known.withColumnRenamed("known", "verdict").select(*cols).unionByName(judged.select(*cols))
