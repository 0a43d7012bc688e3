"""URL filters by empirical-Bayes host reputation, in column expressions only.

Labelled outcomes of pages are counted by host, and from there by registered domain and by suffix. Each level's outcomes
are beta-binomial around the mean of the level above: the share of bad outcomes of a node is shrunk to its parent's by a
prior whose strength is fitted on the spread of that level's nodes. A host is blocked if the lower posterior bound of its
share of bad outcomes passes a limit, so that few outcomes never block alone. Rules of host and path come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.session import materialize

#: (verdict, host, path).
Rule = tuple[str, str, str]
#: Suffixes of two labels, under which a registered domain has three.
COMPOUND = ("co.uk", "com.au", "com.br", "co.jp", "co.nz", "co.in")
#: Least and greatest correlation of two outcomes of one node: priors worth 9,999 outcomes and one.
LEAST_RHO, MOST_RHO = 1e-4, 0.5
LIMIT, DEVIATIONS = 0.25, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased, and the rest up to ``? #``.

    Both are empty for null and where there is no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does.

    A rule fits its host and all subdomains, if the path starts with its own; of equally long ones the first by text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fitting = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three under a suffix of two labels."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*COMPOUND), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*COMPOUND), two).otherwise(F.substring_index(host, ".", -1))


def strength(nodes: DataFrame) -> float:
    """The prior's worth in outcomes, by the method of moments over nodes (n, k, prior): one row reaches the driver.

    Counts spread around their prior by n m (1 - m) (1 + (n - 1) rho); without nodes of two outcomes rho is the greatest.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("prior")
    spread = F.sum((k - n * m) * (k - n * m) - n * m * (1 - m))
    pairs = F.sum(n * (n - 1) * m * (1 - m))
    rho = nodes.agg(F.coalesce(F.try_divide(spread, pairs), F.lit(MOST_RHO)).alias("rho")).first()["rho"]
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def host_reputation(counts: DataFrame, *, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, n, k, share, bound) of hosts with n outcomes, k of them bad; every host once.

    share is the posterior mean of the share of bad outcomes, bound is ``deviations`` posterior standard deviations
    below it. A host without outcomes has its domain's prior; without any outcomes the whole is Beta(1, 1).
    """
    hosts = counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()

    def shrunk(nodes: DataFrame, name: str) -> tuple[DataFrame, float]:
        nodes = materialize(nodes, f"reputation-{name}")
        worth = strength(nodes)
        return nodes.withColumn("mean", (F.col("k") + worth * F.col("prior")) / (F.col("n") + worth)), worth

    suffixes, _ = shrunk(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit((whole["k"] + 1) / (whole["n"] + 2))), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "domains")
    hosts, worth = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain").select("host", "n", "k", "prior"), "hosts")
    a, b = F.col("k") + worth * F.col("prior"), F.col("n") - F.col("k") + worth * (1 - F.col("prior"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", F.col("mean").alias("share"), (F.col("mean") - deviations * deviation).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """Every page's id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and its host's ``share`` and ``bound``.

    ``outcomes`` holds labelled pages: (id, bad), bad being 1, 0 or null (no outcome). Several rows of an id are as many
    outcomes; ids that no page has count nothing. A rule's verdict holds where one fits, else ``block`` where the host's
    bound passes ``limit`` and ``allow`` where not. Null urls and those without ``://`` have an empty host, a host like
    any other. Null ids and repeated rows stay, each judged alike; other columns are left out; an empty table gives none.

    Pages are counted by host before they shuffle, and meet their host's row by a join of plain tables, of which adaptive
    execution splits a hot host.
    """
    host, path = url_parts(F.col("url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    told = outcomes.select(F.col(outcomes.columns[0]).alias("id"), F.col(outcomes.columns[1]).cast("long").alias("bad")).where("id is not null and bad is not null")
    told = materialize(told.groupBy("id").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), "page-outcomes")
    labelled = named.join(told.hint("merge"), "id", "left")  # outcomes grow with the pages
    counts = materialize(labelled.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")), "host-outcomes")
    known = materialize(host_reputation(counts, deviations=deviations).select("host", "share", "bound"), "host-reputation")
    judged = named.join(known, "host").withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "fit.rule", F.coalesce("fit.verdict", method).alias("verdict"), "share", "bound")
