"""Operator 4, URL filter: rules first, then the reputation of hosts by empirical Bayes; DataFrame functions only.

Outcomes of labelled pages (1 good, 0 bad) are counted by host. A host's rate of good pages has a beta prior whose mean is the
posterior mean of its registered domain, whose prior in turn is centred on its suffix, and that on all pages; each level's
prior strength is estimated from the spread of its groups' rates about their parents (method of moments). A url is allowed
if the lower bound of its host's posterior, mean less `z` standard deviations, is at least `least`; a host without labelled
pages has its domain's posterior as its own, and so on upwards.

The registered domain is the last two labels of the host, or three below the two-label suffixes of SECOND; a host of one
label, an address, or none is its own domain. Counting is a partial aggregation by host, so that a host with a third of all
pages is one row of each task; the verdict table has one row for each host and is broadcast only behind a check of its size.

Result: one row for each page: page_id, host, path, rule, verdict, and bound (null where a rule decides).
Defined results: a null url or one without `://` has an empty host and path, which is judged as a host of its own; with no
labelled page at all every host without a rule is allowed; repeated rows each give a row and count as often; null ids are
kept; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import maybe_broadcast, stored, table

#: (verdict, host, path) of the contract's rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Second-level labels that form a public suffix together with a two-letter country code.
SECOND = ["co", "com", "org", "net", "ac", "gov", "edu"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's prior strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    second = rf"(?:{'|'.join(SECOND)})\.[a-z]{{2}}"
    three = F.regexp_extract(host, rf"([^.]+\.{second})$", 1)
    two = F.regexp_extract(host, r"([^.]+\.[^.0-9][^.]*)$", 1)
    return F.when(three != "", three).when(two != "", two).otherwise(host)


def suffix_of(domain: Column) -> Column:
    at = F.locate(".", domain)
    return F.when(at > 0, F.substring(domain, at + 1, F.length(domain))).otherwise(domain)


def _strength(groups: DataFrame) -> DataFrame:
    """One row: prior strength of a level, from good, n and the parents' mean of its groups."""
    m, n = F.col("parent"), F.col("n")
    rate = F.col("good") / n
    spread = F.sum(n * F.pow(rate - m, 2)) - F.sum(m * (1 - m))  # between groups, beyond what sampling gives
    share = F.sum(m * (1 - m) * n) - F.sum(m * (1 - m))
    s = share / spread - 1  # m (1 - m) / variance - 1, pooled over the groups
    return groups.where(n > 0).agg(F.when(spread > 0, F.least(F.greatest(s, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST)).alias("strength"))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float) -> DataFrame:
    """host and bound; outcomes has host and good (0 or 1) of labelled pages."""
    counted = outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.count("good").cast("double").alias("n"))
    level = hosts.join(counted, "host", "left").fillna(0.0, ["good", "n"])
    level = level.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    level = stored(level, "hosts")
    domains = stored(level.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = domains.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(0.5))).head()[0]
    posterior = lambda s: (F.col("good") + s * F.col("parent")) / (F.col("n") + s)
    suffixes = stored(suffixes.withColumn("parent", F.lit(float(total))), "suffixes")
    s = float(_strength(suffixes).head()[0])
    suffixes = suffixes.select("suffix", posterior(s).alias("parent"))
    domains = stored(domains.join(maybe_broadcast(suffixes), "suffix"), "domains")
    s = float(_strength(domains).head()[0])
    domains = domains.select("domain", posterior(s).alias("parent"))
    level = stored(level.join(maybe_broadcast(domains), "domain"), "hosts")
    s = float(_strength(level).head()[0])
    mean, size = posterior(s), F.col("n") + s
    return level.select("host", (mean - z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, least: float = 0.6, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, bound. outcomes has url and good."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"))
    outcomes = outcomes.where("good is not null").select(host_of(F.col("url")).alias("host"), F.col("good").cast("int").alias("good"))
    hosts = reputation(pages.select("host").distinct(), outcomes, z)
    judged = pages.join(maybe_broadcast(stored(hosts, "bounds")), "host", "left")
    verdict = F.coalesce("decided", F.when(F.col("bound") >= least, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("bound")).alias("bound"))


def page_outcome(html: Column, most: float = 0.02) -> Column:
    """1 if at most this share of a page's characters outside tags and entities are symbols, else 0; null without html."""
    text = F.regexp_replace(html, r"<[^>]*>|&[a-z]+;", " ")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%|{}", ""))
    return F.when(symbols <= most * F.length(text), 1).when(html.isNotNull(), 0)


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.select("url", page_outcome(F.col("html")).alias("good")))


QUERIES = {"op4_url_reputation": op4_url_reputation}
SQL: dict[str, str] = {}
