"""URL verdicts from rules and an empirical-Bayes reputation of hosts.

Pages that a rule decides are the labelled outcomes. Blocked shares are shrunk level by
level, from all pages to suffix, registered domain and host: each level's beta prior has
the mean of the level above and a strength fitted to the spread of its shares by the
beta-binomial method of moments. A page without a rule is blocked if the lower bound of
its host's posterior lies above a threshold, so hosts with few outcomes are let through.

All of it is DataFrame expressions and aggregates. One host may hold a third of all
pages: counts combine before the shuffle and Spark splits skewed joins.

Defined cases
- null url, or none with ``://``: empty host and path; the empty host has a reputation
  like any other.
- the suffix of a host without its port is the longest of ``suffixes`` that it ends with, else
  its last label; the registered domain has one label more. An IP address is a domain of its
  own, and all addresses share the empty suffix.
- any number of rules: up to ``MOST_RULES`` are one expression, more meet the hosts in a join.
- very long urls are ordinary; extra columns are not read.
- no outcome at all: everything without a rule is allowed.
- repeated rows and null page_ids are judged and returned each.
- ties: of equally long rules that fit, the first by name and then verdict counts.
- an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
MOST_RULES = 500
#: Suffixes of two labels under which many domains are registered. A parameter.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
IP = r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\[.*\]$"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path)."""
    host = F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def match_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; of equally long ones the first by name, then verdict."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(sorted(rules, key=lambda r: (r.name, r.verdict), reverse=True), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def join_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path and more) with found, the longest fitting rule of ``rules`` (host, path, verdict).

    Distinct hosts meet the rules of all their endings; a host's rules come to its rows as
    one array, longest first.
    """
    hosts = rows.select("host").distinct()
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    name = F.concat("rule_host", F.col("rule_path"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fits = hosts.withColumn("rule_host", F.explode(endings)).join(rules, "rule_host")
    rule = F.struct((-F.length(name)).alias("order"), name.alias("rule"), "verdict", F.col("rule_path").alias("path"))
    held = fits.groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("__rules"))
    rows = rows.join(held, "host", "left")
    first = F.get(F.filter("__rules", lambda r: F.startswith(F.col("path"), r.path)), F.lit(0))
    return rows.withColumn("found", F.when(first.isNotNull(), F.struct(first.rule.alias("rule"), first.verdict.alias("verdict")))).drop("__rules")


def suffix_and_domain(host: str, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The suffix and the registered domain of a host without a port."""
    longer = "|".join(re.escape(x) for x in sorted(suffixes, key=lambda x: (-len(x), x))) or "(?!)"
    known = F.regexp_extract(host, rf"(?:^|\.)({longer})$", 1)
    suffix = F.when(known != "", known).otherwise(F.substring_index(host, ".", -1))
    labels = F.size(F.split(suffix, r"\."))
    address = F.col(host).rlike(IP)
    return F.when(address, "").otherwise(suffix), F.when(address, F.col(host)).otherwise(F.call_function("substring_index", F.col(host), F.lit("."), -(labels + 1)))


def _strength(groups: DataFrame, least: float, most: float) -> Column:
    """The strength of the beta prior over the groups' shares bad / n, as a scalar subquery."""
    n, bad, k = F.sum("n").cast("double"), F.sum("bad").cast("double"), F.count("*").cast("double")
    mean = bad / n
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) / n - mean * mean
    between = spread - mean * (1 - mean) * k / n
    fitted = F.when(between > 0, mean * (1 - mean) / F.when(between > 0, between) - 1).otherwise(most)
    return groups.where("n > 0").agg(F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), fitted)), F.lit(most)).alias("k")).scalar()


def host_reputation(outcomes: DataFrame, *, suffixes: tuple[str, ...] = SUFFIXES, z: float = 1.645, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """(host, n, bad, low): low is the lower bound of the posterior share of bad pages.

    ``outcomes`` has host and bad: 1, 0 or null (no outcome).
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("bare", F.regexp_replace("host", r":[0-9]*$", ""))
    suffix, domain = suffix_and_domain("bare", suffixes)
    hosts = hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix"))
    hosts = materialize(hosts, "hosts")  # a row per host, read for each level
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = ends.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m")).scalar()
    k1, k2, k3 = (_strength(g, least, most) for g in (ends, domains, hosts))
    ends = ends.select("suffix", ((F.col("bad") + k1 * overall) / (F.col("n") + k1)).alias("suffix_mean"))
    domains = domains.join(ends, "suffix").select("domain", ((F.col("bad") + k2 * F.col("suffix_mean")) / (F.col("n") + k2)).alias("domain_mean"))
    rated = hosts.join(domains, "domain").withColumn("a", F.col("bad") + k3 * F.col("domain_mean")).withColumn("t", F.col("n") + k3)
    mean = F.col("a") / F.col("t")
    low = mean - z * F.sqrt(mean * (1 - mean) / (F.col("t") + 1))
    return rated.select("host", "n", "bad", low.alias("low"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, suffixes: tuple[str, ...] = SUFFIXES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url)."""
    host, path = split_url(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) <= MOST_RULES:
        rows = rows.withColumn("found", match_rules(F.col("host"), F.col("path"), rules))
    else:
        table = rows.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
        rows = join_rules(rows, table)
    bad = F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "block").cast("int"))
    rated = host_reputation(rows.select("host", bad.alias("bad")), suffixes=suffixes, z=z).select("host", "low")
    method = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return rows.join(rated, "host").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"))
