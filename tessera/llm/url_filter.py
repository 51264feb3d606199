"""Filters of web pages by url: fixed rules, and an empirical-Bayes reputation of hosts.

Labelled page outcomes (1: bad) are counted by host. A beta-binomial prior is shrunk down a hierarchy: the suffix's rate
towards the rate of all pages, the registered domain's towards its suffix's, the host's towards its domain's; how strongly,
the spread between hosts says (method of moments). A host is blocked where the lower bound of its posterior rate is over a
threshold, so few or chance outcomes block nobody; an unknown host takes its domain's or suffix's posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Suffixes of two labels under which names are registered (fixed values; others are the last label).
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr", "com.tr", "com.tw", "com.sg")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as (name, verdict): its host or a subdomain of it, and the start of the path. The rules are
    an expression: meant for hundreds of them."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    return F.when(F.substring_index(host, ".", -2).isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def strength(groups: DataFrame, n: str, k: str, least: float = 2.0, most: float = 1000.0) -> float:
    """Prior observations that the spread of rates k / n between groups is worth, by the method of moments: all groups enter,
    four sums reach the driver."""
    r = groups.where(F.col(n) > 0).agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(k).alias("k"), F.sum(F.col(k) * F.col(k) / F.col(n)).alias("kk")).first()
    if not r.n or r.g < 2:
        return most
    p = r.k / r.n
    if p in (0, 1):
        return most
    between = (r.kk - r.n * p * p) / (p * (1 - p)) - (r.g - 1)
    room = r.n - r.nn / r.n - (r.g - 1)
    rho = between / room if room > 0 else 0.0
    return most if rho <= 1 / (most + 1) else max(least, (1 - rho) / rho)


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors from outcomes (host, bad), bad 1 or 0: tables of hosts, domains and suffixes with n, k, mean and low (the
    mean less z posterior standard deviations), and the overall rate. Null hosts or outcomes are left out."""
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("k"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total.k or 0) + 0.5) / ((total.n or 0) + 1.0)
    s_suffix, s_domain, s_host = strength(suffixes, "n", "k"), strength(domains, "n", "k"), strength(hosts, "n", "k")

    def posterior(df: DataFrame, prior: Column, s: float) -> DataFrame:
        a, b = F.col("k") + prior * s, F.col("n") - F.col("k") + (1 - prior) * s
        mean = a / (a + b)
        return df.withColumn("mean", mean).withColumn("low", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1)))

    suffixes = posterior(suffixes, F.lit(overall), s_suffix)
    domains = posterior(domains.join(suffixes.select(F.col("suffix").alias("sfx"), F.col("mean").alias("up")), F.col("suffix") == F.col("sfx")), F.col("up"), s_domain).drop("sfx", "up")
    hosts = posterior(hosts.join(domains.select(F.col("domain").alias("dom"), F.col("mean").alias("up")), F.col("domain") == F.col("dom")), F.col("up"), s_host).drop("dom", "up")
    return hosts, domains, suffixes, overall


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...], limit: float = 0.5, z: float = 1.645, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, by_reputation, n_outcomes, posterior, posterior_low for each row of pages.

    The longest rule that fits decides; else a page is blocked where the posterior bound is over `limit`: that of the host, for
    a host without outcomes its domain's, or else its suffix's. n_outcomes: the host's own; posterior and posterior_low: the
    mean and the bound that the page is judged by, to nine places (null without any). A null url or one without :// has an
    empty host and path, and is allowed without a rule; repeated rows give a row each; urls are taken whole.
    """
    hosts, domains, suffixes, _ = host_reputation(outcomes, z)
    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    p = p.withColumns({"r": rule_of(F.col("host"), F.col("path"), rules), "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for table, name in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix")):
        known = stored(table.where(F.col(name) != "").select(F.col(name).alias(f"{name}_"), F.struct("n", "mean", "low").alias(f"of_{name}")), f"of-{name}")
        p = p.join(known, F.col(name) == F.col(f"{name}_"), "left")
    by = F.coalesce("of_host", "of_domain", "of_suffix")
    own = F.when(F.coalesce(by["low"] > limit, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return p.select(
        F.col("page_id").alias(page_id), "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), own.alias("by_reputation"),
        F.coalesce(F.col("of_host.n"), F.lit(0)).alias("n_outcomes"), F.round(by["mean"], 9).alias("posterior"), F.round(by["low"], 9).alias("posterior_low"),
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """host, bad: pages name the document they show by the number that ends their path; a page is bad where that document is
    labelled toxic or of quality 0. Of several labels of a document the worst holds."""
    number = F.regexp_extract(url_path(F.col(f"`{url}`")), r"/([0-9]{1,18})(?:\.html?)?/?$", 1)
    p = pages.select(url_host(F.col(f"`{url}`")).alias("host"), F.when(number != "", number.cast("long")).alias("doc")).where("doc is not null")
    y = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.greatest(1 - F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0)))).alias("bad"))
    return p.join(y, "doc").select("host", "bad")


def drop_blocked(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), limit: float = 0.5) -> DataFrame:
    """page_id of the pages that stay."""
    return judge_urls(pages, outcomes, rules, limit).where("verdict = 'allow'").select("page_id")
