"""Mixing sources to target weights by hierarchical budgets.

Documents hang under a tree of domain, language and source. A budget of tokens goes down the tree:
the children of a node share its budget by their weights; a child that has fewer tokens than its share (all
its leaves, for as many epochs as allowed) gives the rest to its siblings, again by weight. So a
shortage is made up among siblings first, and reaches the ancestors only when all of a node is short. The
level of a group of siblings is found in closed form: sorted by tokens per unit of weight, those below the
level are used up, the others get weight times level, rounded down.

Each leaf then takes the prefix of its stream: epoch 1 in the order of a seeded hash of the document id,
then epoch 2 in another, as many documents as fit in its budget. The position in the stream is a sum over
bins of the hash (as many as the largest leaf needs for bins of about a thousand documents) and a sum inside the document's bin, so no leaf is
sorted as one group, and groups stay small at any size.

Null tree columns are a node of their own, named ``null``. Null and empty texts have no tokens and fit
wherever the stream has not passed the budget. A weight that is null, zero or below is zero: such a
node gets nothing. Rows that share an id are next to each other in the stream. An empty table gives an
empty table. Texts of any length only count. Other columns are not looked at, so their names cannot clash. All is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import written

#: Least number of bits of the hash that number the bins of a leaf's epoch, and documents of the largest leaf that a bin shall have.
BIN_BITS, BIN_DOCS = 12, 1_024
ORDER_BITS = 60
#: Fixed value: white space between tokens.
SPACE = "[ \t\n\f\r]+"


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda x: x != "")), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``given``: what each node gets of its parent's ``budget``, from its ``weight`` and ``room``."""
    siblings = Window.partitionBy(*parent)
    w = F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("double")
    ready = nodes.withColumn("w", w).withColumn("ratio", F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(float("inf"))))
    before = siblings.orderBy("ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    ready = ready.withColumns({"w_left": F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "b_left": F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))})
    ready = ready.withColumn("used_up", (F.col("w") > 0) & (F.col("room") * F.col("w_left") <= F.col("w") * F.col("b_left")))
    rest_b = F.col("budget") - F.sum(F.when(F.col("used_up"), F.col("room")).otherwise(0)).over(siblings)
    rest_w = F.sum(F.when(F.col("used_up"), 0.0).otherwise(F.col("w"))).over(siblings)
    ready = ready.withColumns({"rest_b": rest_b, "rest_w": rest_w})
    open_share = F.when(F.col("rest_w") > 0, F.floor(F.col("rest_b") * F.col("w") / F.col("rest_w"))).otherwise(0)
    given = F.when(F.col("used_up"), F.col("room")).otherwise(F.least(F.col("room"), open_share))
    return ready.withColumn("given", given.cast("long")).drop("w", "ratio", "w_left", "b_left", "used_up", "rest_b", "rest_w")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column, epochs: int) -> DataFrame:
    """The leaves (levels, tokens) with ``quota``, their part of ``budget``, an expression of ``total`` tokens."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("room")).withColumn("weight", weights.get(path[-1], F.lit(1)))
        nodes = nodes.withColumn("total", F.lit(total).cast("long")).withColumn("budget", budget.cast("long")) if given is None else nodes.join(given, parent)
        shared = share(nodes, parent or [F.lit(0)], path[-1])
        given = shared.select(*path, F.col("given").alias("budget"))
    return given.withColumnRenamed("budget", "quota")


def draw_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch: 60 bits of a seeded hash."""
    text = F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, ORDER_BITS // 4), 16, 10).cast("long")


def select(docs: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column, *, epochs: int = 2, seed: int = 7, doc_id: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """(doc_id, levels, epoch, n_tokens, upto) of every document drawn; ``upto`` is its end in its leaf's stream."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.coalesce(F.col(x).cast("string"), F.lit("null")).alias(x) for x in levels], F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = written(rows)
    leaves = written(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    bits = max(BIN_BITS, min(ORDER_BITS // 2, ((leaves.agg(F.max("docs")).first()[0] or 0) // BIN_DOCS).bit_length()))
    quotas = written(budgets(leaves, levels, weights, budget, epochs))
    drawn = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    drawn = drawn.withColumn("at", draw_order(seed, F.col("epoch"), F.col("doc_id"))).withColumn("bin", F.shiftright("at", ORDER_BITS - bits))
    before = lambda *keys: Window.partitionBy(*levels, *keys).rowsBetween(Window.unboundedPreceding, -1)
    # sums over the bins in two steps, so that the bins of a leaf are no single group either
    bins = drawn.groupBy(*levels, "epoch", "bin").agg(F.sum("n_tokens").alias("own")).withColumn("range", F.shiftright("bin", bits // 2))
    ranges = bins.groupBy(*levels, "epoch", "range").agg(F.sum("own").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before().orderBy("epoch", "range")), F.lit(0))).drop("all")
    bins = bins.withColumn("inner", F.coalesce(F.sum("own").over(before("epoch", "range").orderBy("bin")), F.lit(0))).join(ranges, [*levels, "epoch", "range"]).withColumn("before", F.col("base") + F.col("inner"))
    bins = bins.join(quotas, levels).where("before <= quota").select(*levels, "epoch", "bin", "before", "quota")
    here = Window.partitionBy(*levels, "epoch", "bin").orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.join(bins, [*levels, "epoch", "bin"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(here))
    return placed.where("upto <= quota").select("doc_id", *levels, "epoch", "n_tokens", "upto")
