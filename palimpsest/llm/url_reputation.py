"""URL filter by rules and by the empirical-Bayes reputation of hosts.

Reputation: the share of bad outcomes among a host's labelled pages, shrunk through beta-binomial priors. The prior of a host has
the posterior mean of its registered domain, that of a domain the mean of its suffix, that of a suffix the overall mean.
Each level has one prior strength, by moments: with n outcomes and a parent's mean m, n(p-m)^2/(m(1-m)) has the
expectation 1+(n-1)*rho, and the strength is 1/rho-1. A url is blocked if the posterior's lower bound for its host, the mean less
``Z`` standard deviations, is above ``MAX_BAD``: a host is blocked on evidence, not for want of it.

For reputation alone, user information, port and closing dots are cut off the host. Its suffix is the last label, or the last two
where a country's registry registers below labels such as ``co.uk`` (``REGISTRIES``, a rule rather than a list of all suffixes); the
registered domain has one label more. A numeric address is its own domain, and all of them have one suffix. Pages of one host that
differ in port share its reputation. Rules come first: a rule is a host and a path, fits this host and all its subdomains if
the url's path starts with its path, and the longest wins.

Defined results: a url that is null or has no ``://`` has empty host and path, which fit no rule; hosts like any other
otherwise. An outcome is a label of the page's id: bad if quality is 0, no outcome if it is null; of several, each counts, and for
each page that has the id. Pages with a null id have no outcome. A lower bound that equals ``MAX_BAD`` is allowed. Long urls are
read as a whole. An empty table gives an empty result. Columns not named here aren't looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
Z, MAX_BAD = 1.645, 0.25
#: Bounds of rho, the correlation of outcomes within a group; the strengths lie between 1 and 999.
#: The overall mean counts one outcome more, of this badness: all there is without labels.
FEW_BAD = 0.1
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Labels below which registries of two-letter domains register names, fixed values.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch")
#: The suffix of numeric addresses; no host can have it.
ADDRESSES = "#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """A host without user information, port and closing dots."""
    return F.regexp_replace(host, r"(?s)\A.*@|:[0-9]*\z|\.+(?=(:[0-9]*)?\z)", "")


def domain_and_suffix(bare: Column) -> tuple[Column, Column]:
    address = F.rlike(bare, F.lit(r"\A([0-9]+(\.[0-9]+){3}|\[.*)\z"))
    two = F.rlike(bare, F.lit(rf"(\A|\.)({'|'.join(REGISTRIES)})\.[a-z][a-z]\z"))
    last = lambda n: F.regexp_extract(bare, rf"([^.]*\.){{0,{n - 1}}}[^.]*\z", 0)
    return F.when(address, bare).when(two, last(3)).otherwise(last(2)), F.when(address, ADDRESSES).when(two, last(2)).otherwise(last(1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """(id, n, bad): the labelled outcomes of a page."""
    return labels.filter("quality is not null and doc_id is not null").groupBy(labels["doc_id"].alias("id")).agg(F.count("*").alias("n"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength of a level, from the groups' n and bad and their parents' means."""
    seen = groups.filter("n > 0")
    x = F.pow(F.col("bad") / F.col("n") - mean, 2) * F.col("n") / (mean * (1 - mean))
    k, n, total = seen.agg(F.count("*"), F.sum("n"), F.sum(x)).first()
    rho = (total - k) / (n - k) if k and n > k else 0.0
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def reputation(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) of every bare host. pages: (id, host); found: as outcomes gives them."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = pages.join(found, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = checkpoint(hosts.withColumns({"domain": domain, "suffix": suffix}))
    sums = lambda df: df.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = sums(hosts).first()
    mean = ((bad or 0) + FEW_BAD) / ((n or 0) + 1)
    suffixes = sums(hosts.groupBy("suffix"))
    s = _strength(suffixes, F.lit(mean))
    suffixes = suffixes.select("suffix", ((F.col("bad") + s * mean) / (F.col("n") + s)).alias("above"))
    domains = sums(hosts.groupBy("domain", "suffix")).join(suffixes, "suffix")
    s = _strength(domains, F.col("above"))
    domains = domains.select("domain", ((F.col("bad") + s * F.col("above")) / (F.col("n") + s)).alias("above"))
    hosts = hosts.join(domains, "domain")
    s = _strength(hosts, F.col("above"))
    hosts = hosts.withColumn("mean", (F.col("bad") + s * F.col("above")) / (F.col("n") + s))
    lower = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1))
    return hosts.select("host", "n", "bad", "mean", lower.alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, lower) of every page."""
    urls = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    # a written table on either side lets Spark split the rows of a hot host
    known = reputation(urls.select(F.col("page_id").alias("id"), bare_host(F.col("host")).alias("host")), outcomes(labels))
    hosts = checkpoint(known.select(F.col("host").alias("bare"), "mean", "lower"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    return urls.join(hosts, bare_host(F.col("host")) == F.col("bare")).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mean", "lower")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS id, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
ub AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)\A.*@', ''), ':[0-9]*\z', ''), '\.+\z', '') AS bare FROM u),
h AS (
  SELECT bare AS host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM ub LEFT JOIN o ON ub.page_id = o.id GROUP BY bare),
k AS (SELECT *, regexp_matches(host, '\A([0-9]+(\.[0-9]+){3}|\[.*)\z') AS address, regexp_matches(host, '(\A|\.)(""" + "|".join(REGISTRIES) + r""")\.[a-z][a-z]\z') AS two FROM h),
hs AS (
  SELECT host, n, bad, CASE WHEN address THEN host WHEN two THEN regexp_extract(host, '([^.]*\.){0,2}[^.]*\z') ELSE regexp_extract(host, '([^.]*\.){0,1}[^.]*\z') END AS domain,
    CASE WHEN address THEN '#' WHEN two THEN regexp_extract(host, '([^.]*\.){0,1}[^.]*\z') ELSE regexp_extract(host, '[^.]*\z') END AS suffix FROM k),
g AS (SELECT (coalesce(sum(bad), 0) + 0.1::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM hs),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY suffix),
sk AS (SELECT count(*) AS k, sum(n) AS n, sum(pow(bad / n - m, 2) * n / (m * (1 - m))) AS x FROM s0, g WHERE n > 0),
ss AS (SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, CASE WHEN k > 0 AND n > k THEN (x - k) / (n - k) ELSE 0 END)) - 1 AS s FROM sk),
s1 AS (SELECT suffix, (bad + s * m) / (n + s) AS above FROM s0, g, ss),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY domain, suffix),
d1 AS (SELECT d0.*, above AS m FROM d0 JOIN s1 USING (suffix)),
dk AS (SELECT count(*) AS k, sum(n) AS n, sum(pow(bad / n - m, 2) * n / (m * (1 - m))) AS x FROM d1 WHERE n > 0),
ds AS (SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, CASE WHEN k > 0 AND n > k THEN (x - k) / (n - k) ELSE 0 END)) - 1 AS s FROM dk),
d2 AS (SELECT domain, (bad + s * m) / (n + s) AS m FROM d1, ds),
h1 AS (SELECT hs.host, hs.n, hs.bad, d2.m FROM hs JOIN d2 USING (domain)),
hk AS (SELECT count(*) AS k, sum(n) AS n, sum(pow(bad / n - m, 2) * n / (m * (1 - m))) AS x FROM h1 WHERE n > 0),
hz AS (SELECT 1 / least(0.5::DOUBLE, greatest(0.001::DOUBLE, CASE WHEN k > 0 AND n > k THEN (x - k) / (n - k) ELSE 0 END)) - 1 AS s FROM hk),
h2 AS (SELECT host, n, s, (bad + s * m) / (n + s) AS mean FROM h1, hz),
v AS (SELECT host, CASE WHEN mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (n + s + 1)) > 0.25::DOUBLE THEN 'block' ELSE 'allow' END AS by_method FROM h2),
r AS (
  SELECT page_id, u.host, path, by_method, CASE
    WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM ub u JOIN v ON u.bare = v.host)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN by_method WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict FROM r
"""
