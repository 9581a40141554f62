"""Host reputation for URL filtering: beta-binomial shrinkage from host to registered domain to suffix.

Explicit rules come first (longest fitting rule wins). Every other URL is judged by its host: the
labelled outcomes of the host's pages are shrunk towards its registered domain, which is shrunk towards
its suffix, which is shrunk towards the overall rate. The strength of each prior is estimated from the
spread between the groups of that level (method of moments). A host is blocked when even the lower
posterior bound of its bad rate exceeds ``threshold``.

Only DataFrame functions are used. What reaches the driver is one row of level statistics.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged by the prior
of the empty host; ports, user names and closing dots belong to a host's name but not to its domain; addresses have
no parent but the overall rate; null outcomes count as unlabelled; an empty outcome table leaves the overall prior
(1 bad in 2) with an uncertain bound, so nothing is blocked; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; it fits the host and its subdomains when the path starts alike."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(part, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


#: Second-level labels under which registries of two-letter country suffixes sell names (``co.uk``, ``com.au``).
SHARED = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def name_of(host: Column) -> Column:
    """The host without user, port and a closing dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+(?=(:[0-9]*)?$)", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$")


def suffix_of(host: Column) -> Column:
    """The registry's suffix: the last label, or the last two where a country's registry sells names below its second level.

    An address is a suffix of its own, as are names of one label.
    """
    name = name_of(host)
    two = name.rlike(rf"\.({'|'.join(SHARED)})\.[a-z][a-z]$")
    return F.when(_is_address(name), name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; an address as it is."""
    name = name_of(host)
    two = name.rlike(rf"\.({'|'.join(SHARED)})\.[a-z][a-z]$")
    return F.when(_is_address(name), name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def _strength(row, level: str, low: float, high: float) -> float:
    """Prior strength from the between-group variance of one level."""
    n, bad, k = row[f"n_{level}"] or 0, row[f"bad_{level}"] or 0, row[f"k_{level}"] or 0
    squares, ratio = row[f"sq_{level}"] or 0, row[f"ratio_{level}"] or 0.0
    p = (bad + 1) / (n + 2)
    room = n - squares / n if n else 0
    if k < 2 or room <= 0:
        return high
    between = ratio - 2 * p * bad + p * p * n  # sum of n_i (p_i - p)^2
    share = (between - (k - 1) * p * (1 - p)) / (room * p * (1 - p))
    return high if share <= 0 else min(high, max(low, 1 / share - 1))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, *, z: float = 1.0, least: float = 1.0, most: float = 1000.0
) -> DataFrame:
    """``(host, n, bad, mean, lower)`` of every host of ``pages(page_id, host)``.

    ``outcomes(page_id, bad)``: ``bad`` is boolean, null counts as unlabelled.
    """
    seen = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).select("page_id", F.col("bad").cast("long").alias("bad"))
    hosts = (
        pages.join(seen, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    hosts = settle(hosts)  # one row for each host, read again at every level
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n_domain"), F.sum("bad").alias("bad_domain"), F.first("suffix").alias("suffix"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_domain").alias("n_suffix"), F.sum("bad_domain").alias("bad_suffix"))

    def level(df: DataFrame, n: str, bad: str, name: str) -> DataFrame:
        has = df.where(F.col(n) > 0)
        return has.agg(
            F.sum(n).alias(f"n_{name}"),
            F.sum(bad).alias(f"bad_{name}"),
            F.count(F.lit(1)).alias(f"k_{name}"),
            F.sum(F.col(n).cast("double") * F.col(n)).alias(f"sq_{name}"),
            F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)).alias(f"ratio_{name}"),
        )

    stats = {
        name: level(df, n, bad, name).first()
        for name, df, n, bad in (
            ("host", hosts, "n", "bad"),
            ("domain", domains, "n_domain", "bad_domain"),
            ("suffix", suffixes, "n_suffix", "bad_suffix"),
        )
    }
    m_host, m_domain, m_suffix = (_strength(stats[k], k, least, most) for k in ("host", "domain", "suffix"))
    overall = ((stats["host"]["bad_host"] or 0) + 1) / ((stats["host"]["n_host"] or 0) + 2)

    shrunk = lambda bad, n, prior, m: (F.lit(m) * prior + F.col(bad)) / (F.lit(m) + F.col(n))
    by_suffix = suffixes.select("suffix", shrunk("bad_suffix", "n_suffix", F.lit(overall), m_suffix).alias("mean_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk("bad_domain", "n_domain", F.col("mean_suffix"), m_domain).alias("mean_domain"))
    mean = shrunk("bad", "n", F.col("mean_domain"), m_host)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(m_host) + F.col("n") + 1))
    return (
        hosts.join(by_domain, "domain")
        .withColumn("mean", mean)
        .select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * sd).alias("lower"))
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *, threshold: float = 0.5, z: float = 1.0
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, lower)`` for each row of ``pages(page_id, url)``."""
    host, path = F.col("host"), F.col("path")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = host_reputation(parsed.select("page_id", "host"), outcomes, z=z).select("host", "lower")
    verdict = F.coalesce(
        matching_rule(host, path, rules, "verdict"), F.when(F.col("lower") > threshold, "block").otherwise("allow")
    )
    return parsed.join(seen, "host", "left").select(
        "page_id", "host", "path", matching_rule(host, path, rules, "text").alias("rule"), verdict.alias("verdict"), "lower"
    )
