"""URL verdicts from rules, and for other hosts from trust and distrust spread over links between hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.checkpoints import work_dir
from .components import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a url; both are empty for null or without ``://``."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; equal lengths go to ``block``. Null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in order
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def spread(seeds: DataFrame, edges: DataFrame, root: str, rounds: int | None, damping: float) -> DataFrame:
    """(``host``, ``score``): personalised PageRank of ``seeds`` (host, seed) over ``edges`` (src, dst, share), in units of a lone seed."""
    scores = seeds.select("host", F.col("seed").alias("score"))
    moved = None
    # Each round moves at most ``damping`` of the mass that the one before moved.
    for i in range(math.ceil(math.log(1e-9 * (1 - damping)) / math.log(damping)) if rounds is None else rounds):
        flow = edges.join(scores, edges["src"] == scores["host"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        both = seeds.join(flow.withColumnRenamed("dst", "host"), "host", "full")
        new = both.select("host", (F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("flow", F.lit(0.0))).alias("score"))
        scores = stored(new, root, str(i))
        total = scores.agg(F.sum("score")).first()[0]
        if moved is not None and abs((total or 0.0) - moved) <= 1e-9 * (moved + 1):
            break
        moved = total or 0.0
    return scores


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html", rounds: int | None = 10,
    damping: float = 0.85, threshold: float = 0.5,
) -> DataFrame:
    """Verdict for every page: (key, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``).

    The demand records hold no urls, so the operator is general. ``rules`` are (``allow`` or ``block``, host, path): a rule fits
    its host and subdomains where the page's path starts with the rule's, and the longest wins. Other pages get the verdict of
    their host. A host's seed of trust (distrust) is the share of its pages that rules allow (block). Trust follows links from host
    to host, distrust follows them backwards, each host passing on ``damping`` of its score by its number of links, for at
    most ``rounds`` rounds (None: as many as it takes) or until nothing moves. A host is blocked if its distrust exceeds its trust by ``threshold`` or more,
    where an isolated host that is blocked as a whole has distrust 1.

    Links within a host, relative links and pages without html add nothing. A null url, or one without ``://``, has empty host
    and path; such pages share the host ``''`` without links. Repeated rows and null keys are judged each for itself; an
    empty table gives no rows; other columns are dropped. All steps are DataFrame operations, and only one sum per round
    reaches the driver.
    """
    root = work_dir(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    views = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1)).alias("links"))
    views = stored(views.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)), root, "views")
    target = host_and_path(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*:?//", "//")))[0]
    links = views.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("link")).select("src", target.alias("dst"))
    links = stored(links.where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), root, "links")
    share = lambda kind: F.avg((F.coalesce(F.col("hit.verdict"), F.lit("")) == kind).cast("double"))
    seeds = stored(views.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), root, "seeds")
    out = links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    back = links.join(links.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    trust = spread(seeds.where("allow > 0").select("host", F.col("allow").alias("seed")), stored(out, root, "out"), f"{root}/trust", rounds, damping)
    distrust = spread(seeds.where("block > 0").select("host", F.col("block").alias("seed")), stored(back, root, "back"), f"{root}/distrust", rounds, damping)
    scores = seeds.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    scores = stored(scores.na.fill(0.0), root, "scores")
    judged = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return views.drop("links").join(scores, "host", "left").select(
        F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", judged).alias("verdict"), "trust", "distrust"
    )
