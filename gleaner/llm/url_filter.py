"""URL filter: a path-template tree for each host, judged by smoothed labelled purity.

All of it is DataFrame work. Every url becomes (host, path). Listed rules decide the urls that they fit; these urls
are also the labelled pages from which the rest are judged:

1. Segments that are numbers, hex ids or the like become wildcards by form, so that pages shrink to (host, shape).
2. Level by level, as long as some branch has deeper pages, a segment that holds too small a share of its parent's pages
   becomes a wildcard too. What lies below a branch with fewer than ``min_pages`` deeper pages is one ``**``: there is
   nothing to learn from so few.
3. Sibling branches whose mix of (blocked, allowed, unlabelled) pages does not differ from their parent's mix, by a
   chi-square test, are merged into one branch.
4. A template with enough labelled pages is blocked if its smoothed share of blocked ones reaches a threshold; one with
   too few asks its parent template, and so on up to the host.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, unless the labelled pages of
the empty host say otherwise (it has none). Long urls are taken whole. Repeated rows are pages of their own: each counts and
comes back. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with the rule's path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Rules up to which the list is written into the plan.
WRITTEN = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeParams:
    """min_share, min_pages: what a segment needs to stay a branch of its own. chi2: branches whose statistic is below it are merged (5.99: two degrees of freedom at
    5 %). alpha, prior: pseudo-count and prior of the purity. min_support: labelled pages a template needs. purity:
    the threshold from which a template is rejected."""

    min_share: float = 0.02
    min_pages: int = 3
    chi2: float = 5.99
    alpha: float = 2.0
    prior: float = 0.5
    min_support: int = 5
    purity: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?`` or ``#``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_index(host: Column, path: Column, rules=RULES) -> Column:
    """Place in ``rules`` of the longest rule that fits, else null, as an expression in the plan: for WRITTEN rules at most."""
    out = None
    for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: -len(x[1][1] + x[1][2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def with_rule(seen: DataFrame, rules=RULES) -> DataFrame:
    """``seen`` (host, path) with rule and _by_rule (verdict) of the longest rule that fits, else nulls. A long list is a
    table: each host's rules are looked up by its suffixes."""
    if len(rules) <= WRITTEN:
        at = rule_index(F.col("host"), F.col("path"), rules)
        told = [F.array(*(F.lit(x) for x in column)) if rules else F.array().cast("array<string>") for column in ([h + p for _, h, p in rules], [v for v, _, _ in rules])]
        return seen.withColumn("_rule", at).withColumns({"rule": F.get(told[0], F.col("_rule")), "_by_rule": F.get(told[1], F.col("_rule"))}).drop("_rule")
    table = seen.sparkSession.createDataFrame([(h, p, v, h + p) for v, h, p in rules], "_suffix string, _path string, _verdict string, _name string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = seen.select("host").distinct().select("host", F.explode(suffixes).alias("_suffix")).join(table, "_suffix")
    own = own.groupBy("host").agg(F.collect_list(F.struct(F.length("_name").alias("n"), F.col("_path").alias("path"), F.col("_verdict").alias("verdict"), F.col("_name").alias("name"))).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["path"])))
    return seen.join(own, "host", "left").withColumn("_best", best).withColumns({"rule": F.col("_best.name"), "_by_rule": F.col("_best.verdict")}).drop("_best", "_rules")


def shape(path: Column) -> Column:
    """The path's segments, variable ones replaced by their form."""

    def form(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
            .when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), "{id}")
            .when(s.rlike(r"[0-9]{3,}"), "{mixed}")
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form)


def _purity(b: Column, a: Column, p: TreeParams) -> Column:
    return (b + p.alpha * p.prior) / (a + b + p.alpha)


def templates(shapes: DataFrame, p: TreeParams) -> DataFrame:
    """(host, shape, n, b, a: pages, blocked and allowed ones) -> (host, shape, template, blocked boolean). Each level is
    stored, as the next reads it more than once."""
    shapes = stored(shapes, "url-shapes")
    sums = [F.sum(c).alias(c) for c in ("n", "b", "a")]
    at = shapes.withColumns({"_t": F.lit(""), "_verdict": F.lit(None).cast("boolean")})
    root = shapes.groupBy("host").agg(*(F.sum(c).alias(f"_r{c}") for c in ("n", "b", "a")))
    at = at.join(root, "host").withColumn("_verdict", F.when(F.col("_ra") + F.col("_rb") >= p.min_support, _purity(F.col("_rb"), F.col("_ra"), p) >= p.purity)).drop("_rn", "_ra", "_rb")
    level, open_ = 0, ~F.col("_t").endswith("/**")
    while not at.where(open_ & (F.size("shape") > level)).isEmpty():
        at = at.withColumn("_s", F.when(open_, F.get("shape", F.lit(level))))
        branch = at.where("_s IS NOT NULL").groupBy("host", "_t", "_s").agg(*sums)
        parent = branch.groupBy("host", "_t").agg(*(F.sum(c).alias(f"_p{c}") for c in ("n", "b", "a")))
        branch = branch.join(parent, ["host", "_t"])
        is_form = F.col("_s").rlike(r"^\{")
        lone = ~is_form & ((F.col("n") < p.min_share * F.col("_pn")) | (F.col("n") < p.min_pages))
        chi2 = F.lit(0.0)
        for own, whole in ((F.col("b"), F.col("_pb")), (F.col("a"), F.col("_pa")), (F.col("n") - F.col("b") - F.col("a"), F.col("_pn") - F.col("_pb") - F.col("_pa"))):
            expected = F.col("n") * whole / F.col("_pn")
            chi2 = chi2 + F.when(whole > 0, (own - expected) * (own - expected) / expected).otherwise(0.0)
        name = F.when(F.col("_pn") < p.min_pages, "**").when(lone, "*").when(~is_form & (chi2 < p.chi2), "~").otherwise(F.col("_s"))
        branch = stored(branch.withColumn("_g", name), "url-branches")
        merged = branch.groupBy("host", "_t", "_g").agg(*(F.sum(c).alias(f"_m{c}") for c in ("b", "a")))
        named = branch.select("host", "_t", "_s", "_g").join(merged, ["host", "_t", "_g"])
        at = at.join(named, ["host", "_t", "_s"], "left")
        at = at.select(
            "host", "shape", "n", "b", "a",
            F.when(F.col("_g").isNotNull(), F.concat("_t", F.lit("/"), "_g")).otherwise(F.col("_t")).alias("_t"),
            F.when(F.col("_ma") + F.col("_mb") >= p.min_support, _purity(F.col("_mb"), F.col("_ma"), p) >= p.purity).otherwise(F.col("_verdict")).alias("_verdict"),
        )
        at = stored(at, "url-tree")
        level += 1
    return at.select("host", "shape", F.col("_t").alias("template"), F.coalesce("_verdict", F.lit(False)).alias("blocked"))


def filter_urls(pages: DataFrame, rules=RULES, params: TreeParams = TreeParams()) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule (null where none fits), verdict, template. One row for each page;
    repeated rows are repeated. Other columns of ``pages`` are not looked at."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = with_rule(seen, rules).withColumn("shape", shape(F.col("path")))
    shapes = seen.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_by_rule") == "block").alias("b"), F.count_if(F.col("_by_rule") == "allow").alias("a")
    )
    judged = templates(shapes, params)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return seen.join(judged, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("_by_rule", method).alias("verdict"), "template")
