"""Pages judged by rules and by the reputation of their hosts (column functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import UPPER, stored

#: Suffixes of two labels below which names are registered; one label otherwise.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and verdict, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules equally
    long, the first in code-point order wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} become one expression")
    dotted = F.concat(F.lit("."), host)
    found = [
        F.when(
            dotted.endswith("." + rule_host) & path.startswith(rule_path),
            F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, none)


def name_of(host: Column) -> Column:
    """The host without user and port, and without a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::\d*)?$", "")


def is_address(host: Column) -> Column:
    """Whether the host is a number, not a name: such a host has no domain above it."""
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix below which names are registered; an address is its own."""
    host = name_of(host)
    last_two = F.substring_index(host, ".", -2)
    short = F.when(last_two.isin(list(long_suffixes)), last_two).otherwise(F.substring_index(host, ".", -1))
    return F.when(is_address(host), host).otherwise(short)


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """One label more than the suffix; the host itself where it has no more."""
    host = name_of(host)
    long = F.substring_index(host, ".", -2).isin(list(long_suffixes))
    return (
        F.when(is_address(host), host)
        .when(long, F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def strength() -> Column:
    """Weight of the prior in labelled pages, by the moments of ``k`` of ``n`` around mean ``m``.

    Beta-binomial counts vary by n m (1 - m) (1 + (n - 1) rho), and the weight is 1 / rho - 1.
    Rounded, so that the order of adding up does not show.
    """
    spread = F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    rho = F.when(scale > 0, spread / scale).otherwise(F.lit(1.0))
    bounded = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.round(rho, 9)))
    return 1 / bounded - 1


def shrink(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Counts of one level with the parent's mean as prior: adds a, b and the shrunk mean."""
    known = children.join(parents.select(parent, F.col("mean").alias("m")), parent)
    weight = known.groupBy("whole").agg(strength().alias("s"))  # one row
    return (
        known.join(F.broadcast(weight), "whole")
        .withColumn("a", F.col("s") * F.col("m") + F.col("k"))
        .withColumn("b", F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("k"))
        .withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        .drop("s", "m")
    )


def host_reputation(
    pages: DataFrame,
    outcomes: DataFrame,
    z: float = 1.645,
    long_suffixes: Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """Posterior share of bad pages per host: host, n, k, mean, lower, upper.

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0 or 1; several per page all
    count, nulls do not). Each level's counts are shrunk to the mean of the level above: the whole,
    suffix, registered domain, host. The bounds are ``z`` standard deviations of the posterior
    beta from its mean. Hosts without outcomes get their domain's prior.
    """
    counted = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k")
    )
    hosts = stored(
        pages.select("page_id", "host")
        .join(counted, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
        .withColumn("whole", F.lit("all")),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("whole", "suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("whole", "suffix").agg(*sums)
    whole = suffixes.groupBy("whole").agg(*sums).select("whole", ((F.col("k") + 0.5) / (F.col("n") + 1)).alias("mean"))
    # written, as the level below reads each twice
    by_suffix = stored(shrink(suffixes, whole, "whole"), "suffixes")
    by_domain = stored(shrink(domains, by_suffix, "suffix"), "domains")
    by_host = shrink(hosts, by_domain, "domain")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return by_host.select(
        "host", "n", "k", "mean",
        F.greatest(F.lit(0.0), F.round(F.col("mean") - z * deviation, 9)).alias("lower"),
        F.least(F.lit(1.0), F.round(F.col("mean") + z * deviation, 9)).alias("upper"),
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    max_bad: float = 0.25,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
    long_suffixes: Sequence[str] = LONG_SUFFIXES,
) -> DataFrame:
    """A verdict per page: page_id, host, path, rule, verdict, lower.

    The longest rule decides; without one, a page is blocked when the lower bound of its host's
    share of bad pages is over ``max_bad``. A null url, or one without ``://``, has an empty host
    and path and is judged as the host of that name. Repeated rows are judged each for itself.
    """
    known = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    reputation = host_reputation(known, outcomes, z, long_suffixes)
    found = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    return (
        known.join(reputation.select("host", "lower"), "host")
        .withColumn("found", found)
        .select(
            "page_id", "host", "path", F.col("found.rule").alias("rule"),
            F.coalesce("found.verdict", learned).alias("verdict"), "lower",
        )
    )
