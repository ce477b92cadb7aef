"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The leaves of a tree (such as domain, language, source) hold texts. A token budget is split among the children of every
node by their weights. A child that cannot use its share is given all it has, and what is left goes to its siblings by
their weights; only what a whole family cannot use goes to the family's own siblings, since a family counts with the sum
of what its leaves can give. Each leaf then takes a prefix of its own sequence of seeded epochs: every epoch orders the
leaf's texts by a hash of seed, epoch and id, whole epochs come first, the last one ends with the text that reaches the
budget.

The cut of the last epoch is found without sorting a leaf: token sums over the next two digits of the hash narrow it down
to one of 256 parts, round after round, until a part is small. Only the sums of parts and the last part are gathered, so
a leaf with a third of all texts costs no more in one place than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, join_small, written

#: Texts of a part from which it is narrowed down no further.
SMALL_PART = 128
DIGITS = 2


def approximate_tokens(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def epoch_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """32 hex digits that order an epoch of a leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(column: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1)
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(1))


def split_budget(nodes: DataFrame, parent: list[str], child: str, weights: dict[str, int]) -> DataFrame:
    """Split ``budget`` of each parent among its children, given their ``capacity``; adds ``share`` (whole tokens).

    Children in order of capacity per weight: those whose capacity is below their part of what is left get all of it,
    the others share the rest by weight.
    """
    w = _weight(child, weights)
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("w"), child)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = nodes.withColumn("w", w.cast("long")).withColumn("level", (F.col("budget") - before).cast("double") / rest)
    full = F.col("capacity") / F.col("w") <= F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy(*parent))
    share = F.when(full, F.col("capacity")).otherwise(F.floor(F.col("w") * level).cast("long"))
    return out.withColumn("share", share).drop("w", "level")


def leaf_shares(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, docs) with their ``share`` of the whole budget, from the root down."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")).select(budget.cast("long").alias("budget"))
    above = None
    for depth, level in enumerate(levels):
        here = levels[: depth + 1]
        family = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        # One row for the whole corpus, then one for each node of the level above.
        family = family.crossJoin(F.broadcast(total)) if above is None else family.join(above, here[:-1])
        above = split_budget(family, here[:-1], level, weights.get(level, {})).select(*here, F.col("share").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "share"), levels)


def copies(docs: DataFrame, tree: dict[str, Column], weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens: Column | None = None, name: str = "__copies") -> DataFrame:
    """``docs`` and the column ``name``: in how many epochs of its leaf's token-prefix each row occurs, 0 if in none.

    ``tree`` names the levels from the root and gives each an expression over ``docs``; nulls are a node of their own,
    "". ``weights`` are whole numbers by level and node, 1 where none is given. The budget is ``budget_percent`` of all
    tokens; what no leaf can use within ``max_epochs`` stays unused. Rows without tokens count as selected where the
    prefix passes them. Repeated rows of one id stay together, and so do all rows of a leaf without an id. An empty table
    gives no rows. Besides ``name``, which must be new, the result has the columns of ``docs``, whatever they are called.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"there is a column {name} already")
    names = [f"__{x}" for x in tree]
    size = tokens if tokens is not None else approximate_tokens(F.col("text"))
    nodes = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, tree.values(), strict=True)]
    # The columns of ``docs`` are one struct, so that their names cannot clash with those used here.
    table = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), *nodes)
    rows = written(docs.select(*nodes, F.col(id_col).alias("__id"), size.alias("__tokens")), "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    budget = F.floor(F.col("all_tokens") * budget_percent / 100)
    shares = leaf_shares(leaves, names, {f"__{k}": v for k, v in weights.items()}, budget, max_epochs)
    has = F.col("tokens") > 0
    plan = shares.select(*names, "docs", F.when(has, F.floor(F.col("share") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long").alias("__whole"), F.when(has, F.col("share") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long").alias("__rest"))
    plan = written(plan, "mix-plan")

    # Narrow the cut of each leaf's last epoch down, two hash digits a round.
    part = join_small(rows, plan.filter("__rest > 0").withColumnRenamed("docs", "__docs"), names, "inner").withColumn("__h", epoch_hash(seed, F.col("__whole"), F.col("__id")))
    cut = plan.filter("__rest > 0").select(*names, F.lit("").alias("__prefix"), F.col("__rest").alias("__need"), F.col("docs").alias("__docs"))
    at = 0
    while at < 32 and (cut.agg(F.max("__docs")).first()[0] or 0) > SMALL_PART:
        inside = join_small(part.drop("__docs"), cut, names, "inner").filter(F.substring("__h", 1, at) == F.col("__prefix"))
        sums = inside.groupBy(*names, "__need", F.substring("__h", 1, at + DIGITS).alias("__prefix")).agg(F.sum("__tokens").alias("__sum"), F.count(F.lit(1)).alias("__docs"))
        before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*names).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("__before", before).filter("__before < __need and __before + __sum >= __need")
        cut = written(sums.select(*names, "__prefix", (F.col("__need") - F.col("__before")).alias("__need"), "__docs"), "mix-cut")
        at += DIGITS
    inside = join_small(part.drop("__docs"), cut.drop("__docs"), names, "inner").filter(F.substring("__h", 1, at) == F.col("__prefix"))
    keys = inside.groupBy(*names, "__need", "__h").agg(F.sum("__tokens").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*names).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = written(keys.withColumn("__before", before).filter("__before < __need").groupBy(*names).agg(F.max("__h").alias("__cut")), "mix-last")

    out = join_small(table, written(plan.select(*names, "__whole", "__rest").join(last, names, "left"), "mix-leaves"), names, "left")
    taken = (F.col("__rest") > 0) & (epoch_hash(seed, F.col("__whole"), F.col("__id")) <= F.col("__cut"))
    return out.select("__row.*", (F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("int")).cast("int").alias(name))
