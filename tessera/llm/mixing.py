"""Mixing sources to target weights by hierarchical budgeting.

The levels (say domain, language, source) form a tree.  The token budget goes down the tree by the weights
of siblings.  A node can take no more than its leaves hold in ``max_epochs`` epochs; what a short node
cannot take goes to its siblings in proportion to their weights, and only what all siblings together cannot
take goes up to the parent's siblings: going down, each node's share is limited by the capacity of its
whole subtree, so a subtree that gets a budget can always place it.  The limited shares of a sibling set
solve sum(min(level * weight, capacity)) = budget, in closed form over siblings sorted by capacity / weight.

A leaf fills its budget with whole epochs and then a prefix, in the seeded order of the next epoch, of the
rows whose running token count stays within the rest.  The order is by md5(seed:epoch:identifier); its
first digits split a leaf into thousands of ranges whose token sums find the one range where the prefix
ends, so only that range is ever sorted, however large the leaf.  The last place taken there is the leaf's
cut: a row is in the prefix if its place isn't after the cut, so texts are never shuffled; they only meet the
table of leaves, which is broadcast behind a check of its size.

Results: texts of any length are counted whole; places that tie (equal identifiers) are taken together; rows without tokens (null, empty or blank text) go with their place in the order (they cost
nothing); a null level value is a node of its own named ``(null)``; a node without a weight has weight 1,
a weight of 0 or less excludes it; rows with a null identifier order as ``null``; repeated identifiers
share one place: all of them are taken or none; other columns pass through whatever their names; a budget above capacity takes everything; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, token_count, without

NO_NAME = "(null)"
#: Leaf tables of so many bytes at most are broadcast.
BROADCAST_BYTES = 32 << 20


def _weights(level: int, weights: dict) -> Column:
    """Weight of the node named ``l{level}``; keys are (level, name)."""
    own = {name: w for (at, name), w in weights.items() if at == level}
    out = F.lit(1.0)
    for name, w in sorted(own.items()):
        out = F.when(F.col(f"l{level}") == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, depth: int, weights: dict, budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (l0.., tokens, docs) with the leaf's ``budget`` in tokens.

    ``budget`` may use the columns ``all_tokens`` (the table's total).
    """
    now = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    for k in range(depth):
        now = now.withColumn(f"w{k}", _weights(k, weights))
    ok = F.lit(True)
    for k in range(depth):
        ok = ok & (F.col(f"w{k}") > 0)
    now = now.where(ok)
    nodes = now.agg(F.sum("tokens").alias("all_tokens")).select(budget.cast("double").alias("budget"))
    keys: list[str] = []
    for k in range(depth):
        level = now.groupBy(*[f"l{j}" for j in range(k + 1)], f"w{k}").agg(F.sum("cap").alias("cap"))
        level = level.join(F.broadcast(nodes), how="cross") if not keys else level.join(nodes, keys)
        siblings = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        order = siblings.orderBy((F.col("cap") / F.col(f"w{k}")).asc(), f"l{k}")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = level.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum(f"w{k}").over(after))
        level = level.withColumn("water", F.when(F.col("cap") / F.col(f"w{k}") >= (F.col("budget") - F.col("full")) / F.col("rest"), (F.col("budget") - F.col("full")) / F.col("rest")))
        level = level.withColumn("water", F.min_by("water", F.when(F.col("water").isNotNull(), F.col("cap") / F.col(f"w{k}"))).over(siblings))
        level = level.withColumn("share", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col(f"w{k}"))))
        keys = [f"l{j}" for j in range(k + 1)]
        nodes = level.select(*keys, F.col("share").alias("budget"))
    return now.join(nodes, keys).select(*keys, "tokens", "docs", F.floor(F.col("budget") + F.lit(1e-6)).cast("bigint").alias("budget"))


def _narrow(df: DataFrame, levels: list[Column], id_col: str, tokens: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), tokens.alias("t"), *[F.coalesce(x.cast("string"), F.lit(NO_NAME)).alias(f"l{k}") for k, x in enumerate(levels)])


def plan(df: DataFrame, levels: list[Column], weights: dict, budget: Column, id_col: str, tokens: Column, seed: int, max_epochs: int) -> DataFrame:
    """(l0.., budget, epochs, left, cut): whole epochs of each leaf, and the last place its next epoch takes."""
    rows = cut(_narrow(df, levels, id_col, tokens))
    keys = [f"l{k}" for k in range(len(levels))]
    leaves = rows.groupBy(*keys).agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"))
    got = budgets(leaves, len(levels), weights, budget, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(max_epochs)).cast("int")
    whole = F.least(whole, F.lit(max_epochs))
    got = cut(got.withColumn("epochs", whole).withColumn("left", F.when(F.col("epochs") >= max_epochs, F.lit(0)).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens")).cast("bigint")))
    most = got.agg(F.max("docs")).first()[0] or 1
    digits = max(2, math.ceil(math.log(max(most / 4096, 2), 16)) + 2)
    open_rows = rows.join(got.where(F.col("epochs") < max_epochs).select(*keys, "epochs", "left"), keys)
    open_rows = open_rows.withColumn("h", _place("id", seed, F.col("epochs"))).withColumn("b", F.substring("h", 1, digits))
    sums = open_rows.groupBy(*keys, "left", "b").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("c", F.sum("t").over(upto)).where(F.col("c") > F.col("left")).groupBy(*keys).agg(F.min_by("b", "b").alias("end"), F.min_by(F.col("c") - F.col("t"), "b").alias("gone"))
    leaf = got.join(ends, keys, "left").select(*keys, "budget", "epochs", "left", F.coalesce("end", F.lit("~")).alias("end"), "gone")
    leaf = cut(leaf)
    edge = open_rows.select(*keys, "id", "t", "h", "b").join(leaf.where("end <> '~'").select(*keys, "end", "gone", "left"), keys).where("b = end")
    run = Window.partitionBy(*keys).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = edge.withColumn("c", F.sum("t").over(run) + F.col("gone")).where(F.col("c") <= F.col("left")).groupBy(*keys).agg(F.max("h").alias("last"))
    # the range's own name sorts after all places before the range and before all places in it; "~" after all
    return cut(leaf.join(last, keys, "left").select(*keys, "budget", "epochs", "left", F.coalesce("last", "end").alias("cut")))


def _place(id_name: str, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(id_name)))


def mix(df: DataFrame, levels: list[Column], weights: dict, budget: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, max_epochs: int = 1, tokens: Column | None = None) -> DataFrame:
    """Rows of ``df``, once for each epoch that takes them, with the column ``epoch`` (from 0).

    ``levels``: columns from root to leaf; ``weights``: (level number, node name) -> weight; ``budget``: a
    column over ``all_tokens``.
    """
    base = without(df, "epoch")
    tokens = token_count(F.col(text_col)) if tokens is None else tokens
    leaf = plan(df, levels, weights, budget, id_col, tokens, seed, max_epochs)
    keys = [f"l{k}" for k in range(len(levels))]
    names = dict(zip(keys + ["epochs", "cut", "id"], fresh(base.columns + ["epoch"], *keys, "epochs", "cut", "id")))
    rows = base.select("*", *[F.coalesce(x.cast("string"), F.lit(NO_NAME)).alias(names[k]) for k, x in zip(keys, levels)], F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias(names["id"]))
    small = leaf.select(*[F.col(k).alias(names[k]) for k in [*keys, "epochs", "cut"]])
    size = small.agg(F.sum(sum((F.octet_length(names[k]) for k in [*keys, "cut"]), F.lit(64))).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    rows = rows.join(small, [names[k] for k in keys])
    whole = F.col(names["epochs"])
    more = (whole < max_epochs) & (_place(names["id"], seed, whole) <= F.col(names["cut"]))
    count = whole + F.when(more, 1).otherwise(0)
    return rows.where(count > 0).select(*[F.col(f"`{c}`") for c in base.columns], F.explode(F.sequence(F.lit(0), count - 1)).alias("epoch"))
