"""URL filter: explicit rules, then an empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain
and suffix. Each level's rate is a beta-binomial posterior whose prior mean
is its parent's posterior mean (suffix under the whole, domain under suffix,
host under domain) and whose strength is estimated from all nodes of the
level by the method of moments. A host is allowed if the lower bound of its
posterior (mean less ``Z`` standard deviations) reaches ``THRESHOLD``; a host
without outcomes is judged by its prior.

Rules are ``(verdict, "host/path")``; a rule fits its host and all
subdomains if the path of the url starts with the rule's; the longest fitting
rule wins and overrides the reputation.

Only DataFrame expressions are used; one row per host is the largest
grouped table, and outcomes are pre-aggregated before any shuffle.

Defined results: a null url, or one without ``://``, has empty host and
path, and is judged as an unknown host; null outcomes do not count; repeated
rows are judged alike and their outcomes count each; empty tables give an
empty result, and without any outcome the prior mean is one half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

Z = 1.645
THRESHOLD = 0.5
#: Bounds of the intra-class correlation that sets a prior's strength.
RHO = (0.001, 0.5)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url):
    """Host of a url column, A-Z lower-cased; '' if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """Path of a url column; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str]]):
    """``struct(rule, verdict)`` of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_of(host):
    """Registered domain: the last two labels of the host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host):
    """Suffix: the last label of the host."""
    return F.substring_index(host, ".", -1)


def strength(nodes: DataFrame) -> float:
    """Prior strength of a level from ``nodes(n, x, prior)`` (one job, one
    row to the driver): the method of moments for the intra-class
    correlation rho gives ``1 / rho - 1``."""
    var = F.col("prior") * (1 - F.col("prior"))
    r = nodes.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("prior"), 2)).alias("s"),
        F.sum(var).alias("e"), F.sum((F.col("n") - 1) * var).alias("d")).first()
    rho = (r["s"] - r["e"]) / r["d"] if r["d"] else RHO[1]
    return 1.0 / min(max(rho, RHO[0]), RHO[1]) - 1.0


def posterior_mean(k: float):
    return (F.lit(k) * F.col("prior") + F.col("x")) / (F.lit(k) + F.col("n"))


def reputation(hosts: DataFrame) -> DataFrame:
    """``(host, mean, bound)`` for ``hosts(host, n, x)``: labelled pages and
    good ones of every host to judge."""
    h = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = h.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    whole = total["x"] / total["n"] if total["n"] else 0.5
    # domains and suffixes are few against pages, but unbounded: joined, not
    # collected; Spark broadcasts them only if their size allows it
    s = cut(h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("prior", F.lit(whole)))
    s = s.select("suffix", posterior_mean(strength(s)).alias("prior"))
    d = cut(h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(s, "suffix"))
    d = d.select("suffix", "domain", posterior_mean(strength(d)).alias("prior"))
    j = cut(h.join(d, ["suffix", "domain"]))
    k = F.lit(strength(j))
    a, b = k * F.col("prior") + F.col("x"), k * (1 - F.col("prior")) + F.col("n") - F.col("x")
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return j.select("host", mean.alias("mean"), (mean - Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
          threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (input
    columns of those names are replaced). ``outcomes(url, good boolean)`` are
    the labelled pages. Runs jobs; tables of hosts go to the shared folder."""
    o = outcomes.where("good is not null").select(host_of(F.col("url")).alias("host"), F.col("good"))
    counted = o.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("x"))
    every = pages.select(host_of(F.col(url_col)).alias("host")).distinct()
    hosts = cut(every.join(counted, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "x"))))
    judged = cut(reputation(hosts).select(F.col("host").alias("__host"),
                                          F.when(F.col("bound") >= threshold, "allow").otherwise("block").alias("__by_host")))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    p = pages.select(*rest, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    return p.join(judged, p["host"] == judged["__host"]).select(
        *rest, "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.col("__by_host")).alias("verdict"))
