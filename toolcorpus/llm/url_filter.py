"""URL filter: rules first, then trust and distrust propagated over the host graph."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import materialize

DAMPING, TOLERANCE = 0.85, 1e-6
# A host is blocked if its distrust is over this many times its trust.
RATIO = 2.0
# Fixed values: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if the url is null or has none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, else null. A rule is ``host/path prefix``."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: pages of ``src`` that link to another host ``dst``, from ``href`` values with a host."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    full = F.transform(hrefs, lambda h: F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("http:"), h)).otherwise(h))
    hosts = F.array_distinct(F.transform(full, host_of))
    return (pages.select(host_of(F.col(url_col)).alias("src"), F.explode(hosts).alias("dst"))
            .where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n")))


def rounds_for(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which no graph changes by more than ``tolerance``; the first change is ``2 * damping`` at most."""
    return max(1, math.ceil(math.log(tolerance / 2) / math.log(damping))) + 2


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)`` by personalised PageRank with restart at the seeds.

    ``seeds`` has ``host, good, bad`` (weights, any scale); ``links`` has ``src,
    dst, n``. Both kinds are scaled by the weight of all seeds, so the two scores
    compare as masses of pages. Trust follows links, distrust goes against them. What a host
    without a way on holds goes back to the seeds. Rounds end when both sums of
    changes are within ``tolerance``: each round shrinks them by ``damping``, which
    bounds the rounds unless ``rounds`` does. Too few rounds are an error. No seeds of a kind: that score is zero
    everywhere. Each round is two joins and one sum by host, with map-side
    combine, written to the shared folder; sums of one row go to the driver.
    """
    rounds = rounds_for(damping, tolerance) if rounds is None else rounds
    out_n = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    edges = materialize(links.join(out_n, "src").join(in_n, "dst").select(
        "src", "dst", (F.col("n") / F.col("out_n")).alias("fwd"), (F.col("n") / F.col("in_n")).alias("back")), "links")
    sums = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    whole = float((sums["good"] or 0) + (sums["bad"] or 0))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(whole) if whole else F.lit(0.0)
    ends = edges.select(F.col("src").alias("host"), F.lit(True).alias("fwd"), F.lit(False).alias("back")).union(
        edges.select(F.col("dst"), F.lit(False), F.lit(True)))
    has = ends.groupBy("host").agg(F.max("fwd").alias("fwd"), F.max("back").alias("back"))
    state = (has.join(seeds, "host", "full").select(
        "host", F.coalesce("fwd", F.lit(False)).alias("fwd"), F.coalesce("back", F.lit(False)).alias("back"),
        share("good").alias("good"), share("bad").alias("bad")))
    state = materialize(state.withColumn("trust", F.col("good")).withColumn("distrust", F.col("bad")), "hosts")
    for _ in range(rounds):
        stuck = state.agg(F.sum(F.when(~F.col("fwd"), F.col("trust"))).alias("t"),
                          F.sum(F.when(~F.col("back"), F.col("distrust"))).alias("d")).first()
        given = edges.join(state.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("fwd")).alias("t"), F.lit(0.0).alias("d")).union(
            edges.join(state.select(F.col("host").alias("dst"), "distrust"), "dst").select(
                F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d")))
        given = given.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))

        def step(seed, got, lost):
            back = F.lit(float(lost or 0.0) * whole / sums[seed]) if sums[seed] else F.lit(0.0)
            kept = F.coalesce(F.col(got), F.lit(0.0)) + back * F.col(seed)
            return F.lit(1 - damping) * F.col(seed) + F.lit(damping) * kept

        new = state.join(given, "host", "left").select(
            "host", "fwd", "back", "good", "bad", step("good", "t", stuck["t"]).alias("trust"),
            step("bad", "d", stuck["d"]).alias("distrust"),
            F.abs(step("good", "t", stuck["t"]) - F.col("trust")).alias("dt"),
            F.abs(step("bad", "d", stuck["d"]) - F.col("distrust")).alias("dd"))
        state = materialize(new, "hosts")
        moved = state.agg(F.sum("dt").alias("t"), F.sum("dd").alias("d")).first()
        if max(moved["t"] or 0.0, moved["d"] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"trust and distrust did not settle in {rounds} rounds")
    return state.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    The longest rule that fits decides. Other pages get their host's verdict:
    ``block`` if its distrust is over ``ratio`` times its trust, else
    ``allow``; hosts that no score reaches are allowed. Seeds are the hosts of
    pages that a rule decides, weighted by the number of such pages: allowed
    ones are trusted, blocked ones distrusted. A null url, or one without
    ``://``, has an empty host and path, fits no rule and is allowed; null html
    has no links. Repeated rows are judged each; an empty table gives no rows;
    other columns are ignored.

    Pages come to the host table by a shuffled join, whose hot hosts are split
    at run time. Only the narrow columns are shuffled, never the html.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = materialize(base.withColumn("hit", best_rule(F.col("host"), F.col("path"), rules)), "urls")
    count = lambda v: F.count(F.when(F.col("hit.verdict") == v, 1)).cast("double")
    seeds = base.where("host <> '' and hit is not null").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    scores = propagate(host_links(pages, url_col, html_col), seeds)
    out = base.join(scores, "host", "left")
    method = F.when(F.coalesce(F.col("distrust") > F.lit(ratio) * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce(F.col("hit.verdict"), method).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
