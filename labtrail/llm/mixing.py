"""Mixing sources to target weights by hierarchical budgets, in DataFrame expressions only.

The sources form a tree (domain, language, source). Every leaf can give its tokens as often as
`max_epochs` allows. From the root down, a node deals its budget to its children in proportion to
their weights; a child that cannot use its share takes what it has, and its brothers share the rest
(water filling). A node's capacity is the sum of its leaves', so a shortage is made up by brothers
first and reaches the level above only when a whole family is short. A leaf then emits as many whole
epochs as its budget holds, and of the next epoch the longest token-prefix that fits, in an order
drawn from the seed and the epoch.

Budgets are computed on the leaf table. The prefix needs no sort of a leaf: its rows are counted per
cell of the drawn order (a few leading digits), a running sum over the cells finds the one the budget
ends in, and only that cell's rows are ordered. A leaf with a third of all rows is thus
spread over all tasks.

Defined cases: null or empty texts have no tokens and are never selected; a null key is a branch
of its own, named ''; keys without a weight weigh `other`; rows that agree in id and tokens share a
place in the order and are selected together, or not at all. An empty table gives an empty result.
Columns of the input keep their names; the result's own columns replace equal names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labtrail.llm.common import cut, restored, whole_row, words

#: Leading hexadecimal digits of the drawn order that make a cell: 4,096 cells a leaf.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """`weights` maps each level's column to the integer weights of its values; `share` is the
    budget as a fraction of all tokens there are."""

    levels: tuple[str, ...]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    other: int = 1
    share: float = 0.8
    max_epochs: int = 3
    seed: str = "mix"


def n_tokens(text: str = "text") -> Column:
    """Words, the tokens that budgets count."""
    return F.size(words(F.col(text))).cast("long")


def drawn(mix: Mix, epoch: Column, key: str) -> Column:
    """Place of a row in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(mix.seed), epoch.cast("string"), F.col(key).cast("string")))


def _weight(mix: Mix, level: str) -> Column:
    chain = F.lit(mix.other)
    for value, weight in mix.weights.get(level, {}).items():
        chain = F.when(F.col(level) == value, F.lit(weight)).otherwise(chain)
    return chain


def deal(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Water filling: split `budget` of each parent over nodes with `capacity` and `weight`.

    Adds `given`. Nodes in the order of capacity per weight are full as long as the level that
    fills them is within the budget; the others share what is left by weight.
    """
    family = Window.partitionBy(*parent)
    ranked = family.orderBy("_level", *order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("_level", F.col("capacity") / F.nullif(F.col("weight"), F.lit(0)))
    out = out.withColumns(
        {
            "_used": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "_open": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    out = out.withColumn("_full", (F.col("weight") > 0) & (F.col("_used") + F.col("_level") * F.col("_open") <= F.col("budget")))
    full = F.col("_full")
    out = out.withColumn("_rest", F.col("budget") - F.sum(F.when(full, F.col("capacity")).otherwise(0)).over(family))
    out = out.withColumn("_share", F.sum(F.when(full, 0).otherwise(F.col("weight"))).over(family))
    part = F.col("_rest") * F.col("weight") / F.nullif(F.col("_share"), F.lit(0))
    out = out.withColumn("given", F.when(full, F.col("capacity").cast("double")).otherwise(F.coalesce(part, F.lit(0.0))))
    return out.drop("_level", "_used", "_open", "_full", "_rest", "_share")


def budgets(sized: DataFrame, mix: Mix) -> DataFrame:
    """Leaf table: the levels, `tokens`, `whole` epochs and `rest` tokens of the next epoch."""
    levels = list(mix.levels)
    leaves = sized.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = Window.partitionBy(F.lit(0))
    top = leaves.groupBy(levels[0]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("own"))
    nodes = top.withColumn("budget", F.sum("own").over(total) * F.lit(mix.share)).drop("own")
    nodes = nodes.withColumn("_root", F.lit(0)).withColumn("weight", _weight(mix, levels[0]))
    given = deal(nodes, ["_root"], levels[:1]).select(levels[0], F.col("given").alias("budget"))
    for depth in range(1, len(levels)):
        keys = levels[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).join(given, keys[:-1])
        nodes = nodes.withColumn("weight", _weight(mix, levels[depth]))
        given = deal(nodes, keys[:-1], keys[-1:]).select(*keys, F.col("given").alias("budget"))
    whole = F.least(F.floor(F.col("budget") / F.nullif(F.col("tokens"), F.lit(0))), F.lit(mix.max_epochs))
    out = leaves.select(*levels, "tokens").join(given, levels)
    out = out.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    return out.withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("tokens")).cast("long"))


def _sized(docs: DataFrame, mix: Mix, key: str, text: str) -> DataFrame:
    keys = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in mix.levels]
    return docs.select(F.col(key), *keys, n_tokens(text).alias("tokens"))


def plan(sized: DataFrame, mix: Mix, key: str = "doc_id") -> DataFrame:
    """`budgets` with `last`, the last place of the order that the prefix of the next epoch takes."""
    levels = list(mix.levels)
    leaves = budgets(sized, mix)
    placed = sized.where(F.col("tokens") > 0).join(leaves.select(*levels, "whole", "rest"), levels)
    placed = placed.withColumn("place", drawn(mix, F.col("whole") + 1, key))
    placed = placed.withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    cells = placed.groupBy(*levels, "rest", "cell").agg(F.sum("tokens").alias("cell_tokens"))
    running = Window.partitionBy(*levels).orderBy("cell")
    cells = cells.withColumn("after", F.sum("cell_tokens").over(running))
    cells = cells.withColumn("before", F.col("after") - F.col("cell_tokens"))
    # the cell that the budget ends in; if it ends nowhere, the whole epoch fits
    ends = cells.where((F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest")))
    inside = placed.join(ends.select(*levels, "cell", "before"), [*levels, "cell"])
    order = Window.partitionBy(*levels, "cell").orderBy("place")
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    last = inside.groupBy(*levels).agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("inner_last"), F.max("cell").alias("end_cell")
    )
    out = leaves.join(last, levels, "left")
    # nothing of the end cell fits: everything before it does
    edge = F.coalesce(F.col("inner_last"), F.col("end_cell"), F.lit("g"))
    return out.withColumn("last", F.when(F.col("rest") > 0, edge).otherwise(F.lit("")))


def select(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` as often as they are selected, with all their columns, `tokens` and `epoch`.

    `docs` needs the columns of all levels, the key and the text.
    """
    # the plan reads every row's leaf and tokens several times; texts are read once for it
    leaves = plan(cut(_sized(docs, mix, key, text)), mix, key).select(*mix.levels, "whole", "last")
    keys = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in mix.levels]
    out = _emit(whole_row(docs, key, *keys, n_tokens(text).alias("tokens")), leaves, mix, key)
    return out.select(*restored(out, "tokens", "epoch"))


def _emit(rows: DataFrame, leaves: DataFrame, mix: Mix, key: str) -> DataFrame:
    out = rows.where(F.col("tokens") > 0).join(leaves, list(mix.levels))
    part = drawn(mix, F.col("whole") + 1, key) <= F.col("last")
    times = F.col("whole") + F.when(part & (F.col("whole") < mix.max_epochs), 1).otherwise(0)
    out = out.withColumn("_times", times.cast("int")).where(F.col("_times") > 0)
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "whole", "last")


def selection(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `select`, without the texts: key, levels, tokens and epoch."""
    rows = cut(_sized(docs, mix, key, text))
    return _emit(rows, plan(rows, mix, key).select(*mix.levels, "whole", "last"), mix, key)
