"""Mixing sources to target weights by budgets down a tree.

Documents belong to leaves of a tree (domain, language, source). The token
budget goes down from the root. At each node it is shared among the children by
weight; a child gets no more than its subtree can give in ``epochs`` passes, and
what it lacks goes to its siblings by their weights. Only what the whole subtree
cannot take stays with the parent's siblings, as a child's limit is the
sum of its leaves' limits. Each share is found from one sort of the siblings by
limit per weight.

A leaf then takes whole epochs and, of one more, the longest prefix in that
epoch's order that fits. The order is the MD5 of id, seed and epoch. The prefix
comes from tokens per leaf and slice of the order, and only the slice in which
it ends is looked at row by row; so no leaf is sorted in one task, however
large. Texts are not moved but by the join with the leaves' cuts.

Defined cases: null texts have no tokens; a leaf without tokens comes once; a null level
value is a node of its own; documents with equal ids stand together in the
order, in or out; no documents select none;
weights must not be negative, a weight of 0 takes only what weighted siblings leave;
all columns stay, ``epoch`` is added and replaces one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temblor.session import materialize

BIG = "decimal(38,0)"
#: Leaves that are sent to all tasks at most; above, documents meet them by salted joins.
MOST_BROADCAST = 500_000
SALTS = 32


def attach(rows: DataFrame, table: DataFrame, match: list[Column], small: bool, key: Column) -> DataFrame:
    """Join rows to a table of leaves; a leaf may have very many rows."""
    if small:
        return rows.join(F.broadcast(table), match)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*match, F.col("_salt") == F.col("_copy")]).drop("_salt", "_copy")


def n_words(text: Column) -> Column:
    """Words of a text, as its tokens."""
    body = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("bigint")


def order_of(id_col: Column, seed: int, epoch: Column) -> Column:
    """Place in an epoch's order: 32 hex digits."""
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.md5(F.concat(name, F.lit(":"), F.lit(seed).cast("string"), F.lit(":"), epoch.cast("string")))


def share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Add ``given``: the parent's ``budget`` shared by ``weight``, at most ``limit`` each.

    Rows need ``limit, weight, budget`` and the columns of their parent. All are
    whole numbers; what is lost by rounding is less than one token per child.
    """
    near = F.when(F.col("weight") > 0, F.col("limit").cast("double") / F.col("weight").cast("double"))
    order = Window.partitionBy(*parents).orderBy(near.asc_nulls_last(), *[F.col(c) for c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = (nodes
             .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)).cast(BIG))
             .withColumn("rest", F.sum("weight").over(after).cast(BIG)))
    full = ((F.col("weight") > 0)
            & (F.col("limit").cast(BIG) * F.col("rest") <= (F.col("budget").cast(BIG) - F.col("used"))
               * F.col("weight")))
    # The first sibling that is not full fixes what is left for it and those after.
    found = found.withColumn("full", full)
    whole = Window.partitionBy(*parents)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    found = found.withColumn("left", left.cast(BIG)).withColumn("open", F.coalesce(open_weight, F.lit(0)).cast(BIG))
    part = F.expr("cast(`left` * weight div open as bigint)")
    taken = F.when(F.col("full"), F.col("limit")).when(F.col("weight") > 0, F.greatest(part, F.lit(0)))
    # Without an open weighted sibling the rest goes to those of weight 0, in order.
    zero = F.when(F.col("open") == 0, F.greatest(F.lit(0), F.least(
        F.col("limit"), (F.col("budget") - F.col("used")).cast("bigint")))).otherwise(F.lit(0))
    return (found.withColumn("given", F.coalesce(taken, zero).cast("bigint"))
            .drop("used", "rest", "full", "left", "open"))


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: Column, epochs: int,
                 weights: dict[str, dict[str, int]]) -> DataFrame:
    """``levels, tokens, given`` of every leaf; levels without weights go by their tokens."""
    rows = leaves.withColumn("limit", F.col("tokens") * epochs)
    above = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(
        F.least(budget, F.col("all") * epochs).cast("bigint").alias("budget"))
    # One row with one number: the budget itself.
    current = rows.select(*levels, "tokens", "limit").withColumn("budget", above.scalar())
    for depth, level in enumerate(levels):
        names, parents = levels[:depth + 1], levels[:depth]
        nodes = current.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.sum("limit").alias("limit"),
                                            F.first("budget").alias("budget"))
        if level in weights:
            asked = F.lit(1)
            for value, weight in weights[level].items():
                asked = F.when(F.col(level) == value, F.lit(weight)).otherwise(asked)
            nodes = nodes.withColumn("weight", asked.cast("bigint"))
        else:
            nodes = nodes.withColumn("weight", F.col("tokens"))
        given = share(nodes, parents or ["_root"]) if parents else share(
            nodes.withColumn("_root", F.lit(0)), ["_root"]).drop("_root")
        given = given.select(*[F.col(c).alias(f"g_{c}") for c in names], F.col("given"))
        match = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in names]
        current = (current.join(given, match).withColumn("budget", F.col("given"))
                   .drop("given", *[f"g_{c}" for c in names]))
    return current.select(*levels, "tokens", F.col("budget").alias("given"))


def mix(docs: DataFrame, levels: list[str], budget: Column, weights: dict[str, dict[str, int]] | None = None,
        epochs: int = 4, seed: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected documents with their ``epoch``, from 0; a document may come once per epoch.

    ``budget`` is a number of tokens, as a column over ``all``, the tokens of all
    documents. ``weights`` gives whole numbers per level and value (1 if not named).
    """
    narrow = materialize(docs.select(F.col(id_col).alias("id"), *levels, n_words(F.col(text)).alias("n")))
    leaves = narrow.groupBy(*levels).agg(F.sum("n").alias("tokens"))
    plan = materialize(leaf_budgets(leaves, levels, budget, epochs, weights or {})
                       .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(1))
                       .withColumn("room", F.col("given") - F.col("whole") * F.col("tokens")))
    small = plan.count() <= MOST_BROADCAST
    keys = [F.col(c).alias(f"p_{c}") for c in levels]
    to_plan = plan.select(*keys, "whole", "room")
    match = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in levels]
    ordered = (attach(narrow, to_plan, match, small, F.col("id")).drop(*[f"p_{c}" for c in levels])
               .withColumn("h", order_of(F.col("id"), seed, F.col("whole"))))
    slices = ordered.groupBy(*levels, "room", F.substring("h", 1, 3).alias("slice")).agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*levels).orderBy("slice")
    sums = slices.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    # The slice in which the prefix ends: the first one that does not fit whole.
    ends = (sums.where(F.col("upto") > F.col("room")).groupBy(*levels)
            .agg(F.min("slice").alias("slice"), F.min("before").alias("before"))
            .select(*[F.col(c).alias(f"p_{c}") for c in levels], F.col("slice").alias("p_slice"), "before"))
    inside = (ordered.join(ends, [*match, F.substring("h", 1, 3) == F.col("p_slice")])
              .select(*levels, "h", "n", "before", "room"))
    alike = inside.groupBy(*levels, "h", "before", "room").agg(F.sum("n").alias("n"))
    step = Window.partitionBy(*levels).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (alike.withColumn("upto", F.col("before") + F.sum("n").over(step)).where(F.col("upto") > F.col("room"))
           .groupBy(*levels).agg(F.min("h").alias("cut"))
           .select(*[F.col(c).alias(f"c_{c}") for c in levels], "cut"))
    full = to_plan.join(cut, [F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}")) for c in levels], "left").select(
        *[F.col(f"p_{c}") for c in levels], "whole", "cut")
    rest = docs.drop("epoch") if "epoch" in docs.columns else docs
    chosen = attach(rest, full, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in levels], small, F.col(id_col))
    last = F.coalesce(order_of(F.col(id_col), seed, F.col("whole")) < F.col("cut"), F.lit(True))
    times = F.col("whole") + F.when((F.col("whole") < epochs) & last, 1).otherwise(0)
    passes = F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return chosen.withColumn("epoch", F.explode(passes)).select(*[F.col(f"`{c}`") for c in rest.columns], "epoch")
