"""URL filter: host and path rules, and trust along links for the rest.

A url that a rule fits gets the longest rule's verdict. Hosts are judged by the
link graph: trust starts at hosts in proportion to the share of their pages
that rules allow and follows links (personalised PageRank); distrust starts in
proportion to the share that rules block and goes against links, to those who
link there. A host is blocked when its distrust exceeds its trust by more than
``THRESHOLD``, on a scale where a host whose pages are all blocked, without any
links, has 1.

Both vectors are sums over walks; a step passes on ``DAMPING`` of its mass, so
after k steps at most DAMPING**k of the seeds' mass is still to come. Steps end
when that bound is below ``TOLERANCE``, or when nothing moves any more.

Links of a page: hosts of absolute and protocol-relative ``href`` and ``src``
values, and of mail addresses. Edges count pages once and are pre-aggregated;
everything is done by DataFrame functions.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is allowed; repeated pages count as often as they occur; a null html
has no links; equal lengths of fitting rules cannot occur, as a host and path
fit only one rule of a length; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import store

#: Fixed values: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING = 0.7
TOLERANCE = 0.01
THRESHOLD = 0.25

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?:href|src|HREF|SRC)\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
# a run of such characters is tried from its beginning only (or from the end of the match before)
MAIL = r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"


def after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last, longest rule that fits is asked first
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: pages of a host that link to another host."""
    found = F.array_union(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(MAIL), F.lit(1)))
    clean = F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"^[^@]*@|:[0-9]*$", ""), UPPER, LOWER))
    return (
        pages.where("host <> '' and html is not null")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(clean)).alias("dst"))
        .where("dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def host_scores(pages: DataFrame) -> DataFrame:
    """``host, trust, distrust`` of every host with any, from pages with ``host``,
    ``rule_verdict`` and ``html``."""
    edges = host_edges(pages)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    edges = store(both, "link-edges")
    out_sum = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    moves = store(
        edges.join(out_sum, ["kind", "src"]).select("kind", "src", "dst", (DAMPING * F.col("n") / F.col("total")).alias("w")),
        "link-moves",
    )
    share = lambda verdict: F.avg((F.coalesce(F.col("rule_verdict"), F.lit("")) == verdict).cast("double"))
    seeds = (
        pages.where("host <> ''")
        .groupBy("host")
        .agg(share("allow").alias("trust"), share("block").alias("distrust"))
        .select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass"))
        .where("mass > 0")
    )
    wave = store(seeds.select("kind", "host", "mass"), "link-wave")
    waves = [wave]
    for _ in range(math.ceil(math.log(TOLERANCE) / math.log(DAMPING))):
        step = wave.join(moves.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", "dst")
        wave = store(step.agg(F.sum(F.col("mass") * F.col("w")).alias("mass")).select("kind", F.col("dst").alias("host"), "mass"), "link-wave")
        if wave.isEmpty():
            break
        waves.append(wave)
    every = waves[0]
    for w in waves[1:]:
        every = every.unionByName(w)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return every.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = judged(host_path(rows))
    scores = host_scores(rows).where("trust > 0 or distrust > 0")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust - trust > THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return rows.drop("html", "url").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
