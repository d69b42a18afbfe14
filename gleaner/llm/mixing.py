"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A token budget goes down it: the children of a node share its budget in
proportion to their weights; a child that has too little text takes all it has (``max_epochs`` times over) and what it
leaves goes to its siblings in proportion to theirs. What a node can hold is known from below, so a shortage reaches the
siblings of an ancestor only when a node's children cannot hold it together.

A leaf with budget b and t tokens gives its rows b div t times whole, and once more the prefix of b mod t tokens in a
seeded order of its own for that epoch. The prefix is found without sorting a leaf: tokens are summed by slices of the
seeded key, the slice in which the prefix ends is looked up and sliced in turn until it is small, and only that is ordered.

All of it is DataFrame work. Null text is empty and has no tokens; a null lang or source is a child named ``(none)``;
rows of one doc_id share a key and stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small_enough, stored

LEVELS = ("domain", "language", "origin")
#: Leaves up to which the table of leaves is broadcast; beyond it Spark joins by shuffle.
BROADCAST_LEAVES = 50_000
#: Digits of the key by which a slice is sliced, and rows of a slice that are ordered in one task (more only if they share a
#: key, which rows of one doc_id do).
DIGITS, SLICE_ROWS = 2, 10_000


@dataclass(frozen=True)
class MixParams:
    """share: the budget as a share of the input's tokens. domains: how many there are; a source's domain is its number
    modulo that. The weights hold for the children of each node; a child not named weighs 1."""

    share: float = 0.8
    max_epochs: int = 2
    seed: int = 17
    domains: int = 4
    domain_weights: dict = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    language_weights: dict = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    source_weights: dict = field(default_factory=dict)


def n_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _place(docs: DataFrame, p: MixParams) -> dict[str, Column]:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    return {
        "domain": F.when(number == "", "(none)").otherwise(F.concat(F.lit("d"), F.pmod(F.try_to_number(number, F.lit("999999999")).cast("int"), F.lit(p.domains)))),
        "language": F.coalesce(F.col("lang"), F.lit("(none)")),
        "origin": F.coalesce(F.col("source"), F.lit("(none)")),
    }


def _weight(name: str, weights: dict) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        if v < 0:
            raise ValueError("weights must not be negative")
        out = F.when(F.col(name) == k, float(v)).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, cap, weight, given (to the parent) -> the same with ``given`` of the node.

    Water filling by rounds of sums: the level is what is left for each weight of the children that are not full; those that
    hold no more than their part of it are full from then on, which raises the level for the others. Each round is one
    aggregate, whatever the number of children; rounds end when none of them fills another child."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf"))
    nodes = stored(nodes.select(*parent, name, "cap", "weight", "given", ratio.alias("ratio")), "mix-nodes")
    at, full = nodes.withColumn("level", F.lit(None).cast("double")), -1
    while True:
        open_ = F.col("level").isNull() | (F.col("ratio") > F.col("level"))
        sums = at.groupBy(*parent).agg(
            F.first("given").alias("_given"), F.coalesce(F.sum(F.when(~open_, F.col("cap"))), F.lit(0)).alias("_held"), F.sum(F.when(open_, F.col("weight"))).alias("_weight"), F.count_if(~open_).alias("full")
        )
        level = F.when(F.col("_weight") > 0, (F.col("_given") - F.col("_held")) / F.col("_weight")).otherwise(float("inf"))
        sums = stored(sums.select(*parent, level.alias("level"), "full"), "mix-levels")
        now = sums.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
        at = nodes.join(sums.drop("full"), parent) if parent else nodes.crossJoin(F.broadcast(sums.drop("full")))  # one row
        if now == full:
            break
        full = now
    given = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).when(F.col("weight") > 0, F.floor(F.col("level") * F.col("weight"))).otherwise(0)
    return at.withColumn("given", F.least(F.col("cap"), F.greatest(F.lit(0), given)).cast("long"))


def budgets(leaves: DataFrame, p: MixParams) -> DataFrame:
    """leaves: domain, language, origin, tokens -> the same with ``given``: the tokens that the leaf is to give."""
    weights = dict(zip(LEVELS, (p.domain_weights, p.language_weights, p.source_weights), strict=True))
    given = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * p.share).cast("long").alias("given"))
    for depth, name in enumerate(LEVELS, 1):
        above = list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*LEVELS[:depth]).agg((F.sum("tokens") * p.max_epochs).alias("cap")).withColumn("weight", _weight(name, weights[name]))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))  # given is one row here
        given = _share_out(nodes, above, name).select(*LEVELS[:depth], "given")
    return leaves.join(given, list(LEVELS))


def plan(docs: DataFrame, p: MixParams) -> DataFrame:
    """A row for each leaf: domain, language, origin, tokens, given, whole (epochs) and cut (the largest key of the last
    epoch's prefix; null if there is none). Stored."""
    placed = stored(docs.select("doc_id", *(c.alias(k) for k, c in _place(docs, p).items()), n_tokens(F.col("text")).alias("tokens")), "mix-rows")
    leaves = placed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    given = budgets(leaves, p).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(1).cast("int"))
    given = stored(given.withColumn("rest", F.when(F.col("tokens") > 0, F.col("given") - F.col("whole") * F.col("tokens")).otherwise(0)), "mix-leaves")
    few = _few(given, given)
    keyed = placed.join(few.where("rest > 0").select(*LEVELS, "whole", "rest"), list(LEVELS)).withColumn("key", epoch_key(F.col("doc_id"), F.col("whole") + 1, p.seed))
    # the slice in which a leaf's prefix ends, DIGITS more digits of the key at a time
    at = given.where("rest > 0").select(*LEVELS, "rest", F.lit("").alias("slice"), F.lit(0).cast("bigint").alias("before"))
    for length in range(DIGITS, 33, DIGITS):
        inside = keyed.drop("rest").join(_few(at, given), list(LEVELS)).where(F.col("key").startswith(F.col("slice")))
        slices = inside.groupBy(*LEVELS, "rest", "before", F.substring("key", 1, length).alias("slice")).agg(F.sum("tokens").alias("s"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.withColumn("before", F.col("before") + F.coalesce(F.sum("s").over(running), F.lit(0)))
        at = stored(slices.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") >= F.col("rest"))).select(*LEVELS, "rest", "slice", "before", "n"), "mix-slices")
        if (at.agg(F.max("n")).first()[0] or 0) <= SLICE_ROWS:
            break
        at = at.drop("n")
    inside = keyed.drop("rest").join(_few(at, given), list(LEVELS)).where(F.col("key").startswith(F.col("slice")))
    inside = inside.groupBy(*LEVELS, "key", "before", "rest").agg(F.sum("tokens").alias("s"))
    running = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("s").over(running), F.lit(0))).where("at < rest")
    return stored(given.join(inside.groupBy(*LEVELS).agg(F.max("key").alias("cut")), list(LEVELS), "left"), "mix-plan")


def _few(at: DataFrame, leaves: DataFrame) -> DataFrame:
    """``at``, of a row for each leaf at most, to be broadcast if there are few leaves."""
    return F.broadcast(at) if small_enough(leaves, BROADCAST_LEAVES) else at


def epoch_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, p: MixParams = MixParams(), columns: list[str] | None = None, with_place: bool = True) -> DataFrame:
    """The rows of the mix: ``columns`` of ``docs`` (all, if None) once for each epoch that takes them. with_place adds
    domain, language, origin, epoch (from 1) and tokens; one whose name is among ``columns`` gets underscores before it."""
    columns = docs.columns if columns is None else columns
    leaves = plan(docs, p)
    leaf, at, times_, epoch = fresh(docs, "_leaf", "_at", "_times", "_epoch")
    told = leaves.select(F.struct(*LEVELS).alias(leaf), F.struct("whole", "cut").alias(at))
    rows = docs.withColumn(leaf, F.struct(*(c.alias(k) for k, c in _place(docs, p).items())))
    rows = rows.join(_few(told, leaves), leaf)
    last = epoch_key(F.col("doc_id"), F.col(at)["whole"] + 1, p.seed)
    rows = rows.withColumn(times_, F.col(at)["whole"] + F.coalesce((last <= F.col(at)["cut"]).cast("int"), F.lit(0))).where(F.col(times_) > 0)
    own = [F.col(f"`{c}`") for c in columns]
    every = F.explode(F.sequence(F.lit(1), F.col(times_)))
    if not with_place:
        return rows.select(*own, every.alias(epoch)).drop(epoch)
    names = fresh(docs.select(*own), *LEVELS, "epoch", "tokens")
    values = [*(F.col(leaf)[k] for k in LEVELS), every, n_tokens(F.col("text"))]
    return rows.select(*own, *(v.alias(k) for v, k in zip(values, names, strict=True)))
