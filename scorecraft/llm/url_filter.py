"""URL filters: path rules, and trust and distrust spread over the link graph.

Rules name a host and a path prefix; the longest that fits decides. Pages that
no rule fits are judged by their host. Hosts are joined by the links of their
pages; links inside a host say nothing and are left out. Trust is a
personalised PageRank that starts from the hosts whose pages the rules allow
and follows the links; distrust starts from the hosts whose pages the rules
block and follows the links backwards, as who links to a blocked host is
suspect. Each host starts with the share of its pages that the rules allow (or
block), and is blocked when its distrust exceeds ``ratio`` times its trust.

The ranks are sums of waves: a wave holds what has just arrived at each host,
and the next one is ``damping`` of it, shared over the host's links by their
weight. Masses are integers (``UNIT`` is a whole seed), so the order of sums
and lost executors cannot change a result. Each wave's sum is at most
``damping`` of the one before, rounded down, so waves fade out by themselves:
the work ends with the first empty one, and no mass is left out. ``steps``, if
given, ends it earlier.

Scale: links are summed by pair of hosts before anything is joined; each step
joins the wave with the links by host and is summed again before the shuffle,
with AQE splitting a host of very many links. Each wave is a written table, and
the sums so far are one after every ``GATHER`` waves.

Defined cases: a null url, and one without ``://``, has an empty host and path;
such pages, and hosts that no mass reaches, are allowed unless a rule decides;
null html has no links, one of any length is searched whole (in Spark, one page in
memory at a time); repeated rows count each; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import lower_ascii, stage

UNIT = 1 << 30
DAMPING = (85, 100)
RATIO = 2
#: Waves after which their sums are gathered in one table.
GATHER = 20

#: (verdict, host, path) of the rules to apply.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Targets of links that name a host, with or without a scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]*)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    chain = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chain = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``src, dst, w``: links between different hosts, and how many."""
    found = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("to"),
    ).select("src", lower_ascii(F.col("to")).alias("dst"))
    return found.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))) \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def spread(links: DataFrame, seeds: DataFrame, damping: tuple[int, int], steps: int | None) -> DataFrame:
    """``kind, host, mass``: the ranks of both kinds. ``seeds``: kind, host, mass.

    Kind T follows ``links`` from src to dst, kind D from dst to src.
    """
    up, down = damping
    both = links.select(F.lit("T").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").union(
        links.select(F.lit("D"), F.col("dst"), F.col("src"), "w")
    )
    out = both.groupBy("kind", "host").agg(F.sum("w").alias("out"))
    arcs = stage(both.join(out, ["kind", "host"]), "url-arcs")
    wave = stage(seeds.select("kind", "host", F.expr(f"mass * {down - up} div {down}").alias("mass")).filter("mass > 0"), "url-wave")
    summed = lambda tables: reduce(DataFrame.union, tables).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
    waves, step = [wave], 0
    while steps is None or step < steps:
        step += 1
        share = F.expr(f"(cast(mass as decimal(19, 0)) * cast(w as decimal(18, 0))) div out * {up} div {down}")
        wave = stage(
            wave.join(arcs, ["kind", "host"]).select("kind", F.col("to").alias("host"), share.alias("mass"))
            .groupBy("kind", "host").agg(F.sum("mass").alias("mass")).filter("mass > 0"),
            "url-wave",
        )
        if wave.isEmpty():
            break
        waves.append(wave)
        if len(waves) > GATHER:
            waves = [stage(summed(waves), "url-sums")]
    return summed(waves)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    trusted: Sequence[str] = (),
    blocked: Sequence[str] = (),
    damping: tuple[int, int] = DAMPING,
    steps: int | None = None,
    ratio: int = RATIO,
    unit: int = UNIT,
) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` of every page.

    ``trusted`` and ``blocked`` name further seed hosts (known lists); trust
    and distrust are the host's masses as fractions of a whole seed, which is
    ``unit`` (a coarser one fades out in fewer waves).
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path")).withColumn(
        "hit", longest_rule(F.col("host"), F.col("path"), rules)
    )
    whole = lambda names: F.col("host").isin(*names) if names else F.lit(False)
    share = lambda verdict, named: F.when(whole(named), F.lit(unit)).otherwise(
        F.expr(f"(count_if(hit.verdict = '{verdict}') * {unit}) div count(1)")
    )
    per_host = judged.filter("host <> ''").groupBy("host").agg(
        share("allow", trusted).alias("t"), share("block", blocked).alias("d")
    )
    seeds = per_host.select(
        F.explode(F.array(
            F.struct(F.lit("T").alias("kind"), F.col("t").alias("mass")),
            F.struct(F.lit("D").alias("kind"), F.col("d").alias("mass")),
        )).alias("s"), "host",
    ).select("s.kind", "host", "s.mass").filter("mass > 0")
    ranks = spread(host_links(pages, url_col, html_col), stage(seeds, "url-seeds"), damping, steps)
    by_host = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "T", F.col("mass")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("kind") == "D", F.col("mass")).otherwise(0)).alias("d"),
    )
    trust, distrust = F.coalesce(F.col("t"), F.lit(0)), F.coalesce(F.col("d"), F.lit(0))
    verdict = F.when(distrust > ratio * trust, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(stage(by_host, "url-hosts"), "host", "left").select(
        F.col("__id").alias(id_col), "host", "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), verdict).alias("verdict"),
        (trust / F.lit(float(unit))).alias("trust"),
        (distrust / F.lit(float(unit))).alias("distrust"),
    )
