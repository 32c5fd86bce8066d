"""URL filters: empirical-Bayes host reputation, in DataFrame functions only.

Pages with a known outcome (good or bad) give each host a count of trials and of bad pages. Bad-page
rates are shrunk through beta-binomial priors: the suffix towards the whole, the registered domain
towards its suffix, the host towards its domain. The strength of each prior is the method-of-moments
estimate of how far groups of that level scatter. A page without a rule is blocked if the lower
posterior bound of its host's bad rate reaches `block_at`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.session import through_store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Levels from the whole downwards.
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Shrinkage:
    """Production parameters of the reputation."""

    z: float = 1.6448536269514722  #: the one-sided 95 % bound
    block_at: float = 0.5
    least: float = 1.0  #: bounds of a prior's strength, in pages
    most: float = 1000.0
    start: float = 10.0  #: strength where the scatter can't be estimated
    start_rate: float = 0.5  #: the whole's rate where no page has an outcome


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Labels below a country's that are suffixes too (co.uk, com.au, ...).
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "ne", "net", "nom", "or", "org", "plc", "sch")


def _name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, "^.*@|:[0-9]*$", "")


def _compound(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    country = F.length(F.substring_index(name, ".", -1)) == 2
    return country & F.substring_index(two, ".", 1).isin(*SECOND) & (F.substring_index(name, ".", -3) != two)


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it; the whole name if it has no more."""
    name = _name(host)
    return F.when(_compound(name), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix(host: Column) -> Column:
    """The last label, or the last two where a country's second level is a suffix and something stands before it."""
    name = _name(host)
    return F.when(_compound(name), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, s: Shrinkage) -> DataFrame:
    """One row with a prior's strength, from rows (n, bad) of a level's groups, by the method of moments."""
    rate = F.col("b") / F.col("n")
    scatter = F.col("q") - F.col("n") * rate * rate
    within = rate * (1 - rate)
    free = F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)
    rho = (scatter - within * (F.col("g") - 1)) / (within * free)
    m = F.when((within > 0) & (free > 0), F.when(rho > 0, (1 - rho) / rho).otherwise(F.lit(s.most)))
    return (
        groups.filter(F.col("n") > 0)
        .agg(
            F.sum("n").cast("double").alias("n"),
            F.sum("bad").cast("double").alias("b"),
            F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
            F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("q"),
            F.count("*").cast("double").alias("g"),
        )
        .withColumn("ok", F.coalesce(F.col("n") > 0, F.lit(False)))
        .select(
            F.when(F.col("ok"), F.greatest(F.lit(s.least), F.least(F.lit(s.most), F.try_divide(m, F.lit(1.0)))))
            .otherwise(None)
            .alias("m"),
            F.when(F.col("ok"), rate).alias("rate"),
        )
        .select(F.coalesce("m", F.lit(s.start)).alias("m"), F.coalesce("rate", F.lit(s.start_rate)).alias("rate"))
    )


def host_reputation(outcomes: DataFrame, shrinkage: Shrinkage | None = None) -> DataFrame:
    """Per host: pages with an outcome, bad ones, posterior mean and lower bound of the bad rate.

    `outcomes` has host and bad (true, false, or null for a page without an outcome). Every host in it
    gets a row, also one without outcomes. A null host counts as the empty host. Empty input gives no rows.
    Rows are combined before they are shuffled, so a host with a third of all pages costs one row a task.
    """
    s = shrinkage or Shrinkage()
    host = F.coalesce(F.col("host"), F.lit(""))
    hosts = (
        outcomes.select(host.alias("host"), F.col("bad").cast("boolean").alias("is_bad"))
        .groupBy("host")
        .agg(F.count("is_bad").alias("n"), F.coalesce(F.sum(F.col("is_bad").cast("long")), F.lit(0)).alias("bad"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", suffix(F.col("host")))
    )
    hosts = through_store(hosts, "hosts")  # the pages are read once for all levels
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Each prior is a single row: three numbers a level go to the driver and back as literals.
    prior = {k: _strength(v, s).first() for k, v in zip(LEVELS, (suffixes, domains, hosts), strict=True)}

    def posterior(parent: Column, m: float) -> Column:
        return (F.col("bad") + F.lit(m) * parent) / (F.col("n") + F.lit(m))

    up = suffixes.select("suffix", posterior(F.lit(prior["suffix"].rate), prior["suffix"].m).alias("suffix_rate"))
    mid = (
        domains.join(up, "suffix")
        .select("suffix", "domain", posterior(F.col("suffix_rate"), prior["domain"].m).alias("domain_rate"))
    )
    m = prior["host"].m
    rate, weight = posterior(F.col("domain_rate"), m), F.col("n") + F.lit(m)
    return (
        hosts.join(mid, ["suffix", "domain"])
        .withColumn("rate", rate)
        .withColumn("bound", F.col("rate") - F.lit(s.z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1)))
        .select("host", "domain", "suffix", "n", "bad", "rate", "bound")
    )


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, shrinkage: Shrinkage | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_bound, a row for each row of `pages`.

    Reads page_id and url alone, whatever further columns there are; repeated rows are judged each. Outcomes
    come from the rules: a blocked page is bad, an allowed one good, others teach nothing. A null or
    odd url has an empty host and path and so the verdict of the empty host.
    """
    s = shrinkage or Shrinkage()
    cut = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    cut = cut.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    known = host_reputation(cut.select("host", (F.col("hit.verdict") == "block").alias("bad")), s)
    known = known.select("host", F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound"))
    method = F.when(F.col("bad_bound") >= F.lit(s.block_at), F.lit("block")).otherwise(F.lit("allow"))
    return cut.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), method).alias("verdict"),
        F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_bound", 9).alias("bad_bound"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _level_sql(level: str) -> str:
    return f"""
m_{level} AS (
  SELECT coalesce(CASE WHEN n > 0 AND w > 0 AND free > 0 THEN greatest(1.0, least(1000.0,
           CASE WHEN (sc - w * (g - 1)) / (w * free) > 0
                THEN (1 - (sc - w * (g - 1)) / (w * free)) / ((sc - w * (g - 1)) / (w * free))
                ELSE 1000.0 END)) END, 10.0) AS m,
         coalesce(b / n, 0.5) AS rate
  FROM (SELECT *, q - n * (b / n) * (b / n) AS sc, (b / n) * (1 - b / n) AS w, n - n2 / n - (g - 1) AS free
        FROM (SELECT sum(n)::DOUBLE n, sum(bad)::DOUBLE b, sum(n::DOUBLE * n) n2, sum(bad::DOUBLE * bad / n) q,
                     count(*)::DOUBLE g FROM {level}s WHERE n > 0)))"""


SQL = f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut),
judged AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruling FROM ruled),
hosts AS (
  SELECT host, n, bad, CASE WHEN compound THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix,
         CASE WHEN compound THEN l[-3] || '.' || l[-2] || '.' || l[-1] WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS domain
  FROM (SELECT *, len(l) > 2 AND length(l[-1]) = 2 AND list_contains({list(SECOND)}, l[-2]) AS compound
        FROM (SELECT host, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS l,
                     count(ruling) AS n, count(*) FILTER (WHERE ruling = 'block') AS bad FROM judged GROUP BY host))),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
{_level_sql("suffix")},{_level_sql("domain")},{_level_sql("host")},
sr AS (SELECT suffix, (bad + m * rate) / (n + m) AS r FROM suffixs, m_suffix),
dr AS (SELECT d.suffix, domain, (bad + m * r) / (n + m) AS r FROM domains d JOIN sr USING (suffix), m_domain),
hr AS (
  SELECT host, (bad + m * r) / (n + m) AS rate, n + m + 1 AS w
  FROM hosts h JOIN dr ON h.suffix = dr.suffix AND h.domain = dr.domain, m_host)
SELECT page_id, host, path, rule,
       coalesce(ruling, CASE WHEN rate - 1.6448536269514722 * sqrt(rate * (1 - rate) / w) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 9) AS bad_rate, round(rate - 1.6448536269514722 * sqrt(rate * (1 - rate) / w), 9) AS bad_bound
FROM judged JOIN hr USING (host)
"""
