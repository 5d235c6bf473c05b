"""Mixing sources to target weights by a budget that runs down a tree.

The tree is domain, language, source. Each node has an integer weight among its
siblings (1 where none is given) and a capacity: its tokens times the epochs
allowed. A parent's budget goes to its children by weight; a child that cannot
take its share gets its capacity, and what it leaves goes to its siblings by
weight. As the shares at each level are bounded by the capacity of the whole
subtree, a shortage reaches an ancestor's siblings only once the node's own
siblings are full. For children in ascending order of capacity per weight, the
level at which the rest is shared is a running sum, so the allocation is three
window passes over a table with one row for each leaf.

A leaf takes whole epochs, and of the next epoch the longest prefix, in that
epoch's seeded order, whose tokens fit. The prefix of a leaf that holds a third
of all rows is found without one task seeing that leaf: the order is cut into
cells of some thousand rows by the leading bits of the order key, sums of whole
cells give where each cell starts, and the running sum is taken inside a cell.

DataFrame operations only. Defined results: null domain, language or source is
a node of its own, named by the empty string; a null or empty text has no
token and is taken wherever its place in the order falls within the prefix;
ties in the order go by id, then tokens; an empty table gives no rows. Rows are
taken one by one, whether or not others have the same id. With carried columns,
rows without an id are ordered by a hash of those, which also breaks ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowdex.llm._common import staged

#: Bits of the order key, and rows that a cell of the order should hold.
KEY_BITS, CELL_ROWS = 60, 4096
LEVELS = ("__l0", "__l1", "__l2")


def word_tokens(text: Column) -> Column:
    """Number of runs of characters other than the space."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("long")


def _weight(level: str, weights: Mapping[str, int] | None) -> Column:
    out = F.lit(1).cast("long")
    for name, value in sorted((weights or {}).items()):
        if int(value) != value or value < 1:
            raise ValueError("weights are positive integers")
        out = F.when(F.col(level) == name, F.lit(int(value)).cast("long")).otherwise(out)
    return out


def share(nodes: DataFrame, parents: list[str], order: list[str]) -> DataFrame:
    """nodes: __budget (of the parent), __cap, __w. Adds __got, the node's part:
    the smaller of its capacity and its weight times the common level. With the
    k-1 first nodes full, the k-th has a level for the rest; it is right from the
    first node that it does not fill, and falls from there on."""
    rank = [F.col("__cap") / F.col("__w"), *[F.col(c) for c in order]]
    before = Window.partitionBy(*parents).orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    full = F.coalesce(F.sum("__cap").over(before), F.lit(0))
    open_w = F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    level = (F.col("__budget") - full).cast("double") / open_w
    return (
        nodes.withColumn("__level", level)
        .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.col("__level"))).over(whole))
        .withColumn("__got", F.floor(F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap").cast("double")))))
        .drop("__level")
    )


def plan_leaves(leaves: DataFrame, budget: float, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """leaves: the levels, __tokens, __rows. budget: the part of all tokens to
    take. Gives for each leaf __epochs (whole ones) and __rest (tokens)."""
    parents = ["__all"]
    nodes = leaves.withColumn("__all", F.lit(0))
    caps = nodes.withColumn("__cap", F.col("__tokens") * max_epochs)
    given = caps.groupBy("__all").agg(F.floor(F.sum("__tokens") * F.lit(float(budget))).alias("__budget"))
    for k, level in enumerate(LEVELS):
        own = caps.groupBy(*parents, level).agg(F.sum("__cap").alias("__cap"))
        own = own.withColumn("__w", _weight(level, weights.get(("domain", "lang", "source")[k])))
        got = share(own.join(given, parents), parents, [level])
        parents = [*parents, level]
        given = got.select(*parents, F.col("__got").alias("__budget"))
    epochs = F.when(F.col("__tokens") > 0, F.floor(F.col("__budget") / F.col("__tokens"))).otherwise(0)
    return (
        nodes.join(given, parents)
        .withColumn("__epochs", epochs.cast("long"))
        .withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__tokens"))
        .withColumn("__bits", F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("__rows") / CELL_ROWS)))).cast("int"))
        .select(*LEVELS, "__tokens", "__epochs", "__rest", "__bits", F.col("__budget").alias("__target"))
    )


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    """The place of a row in an epoch: 60 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    domain: Column,
    lang: Column,
    source: Column,
    tokens: Column,
    id_col: str = "doc_id",
    budget: float = 1.0,
    max_epochs: int = 4,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    seed: int = 11,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: id, domain, lang, source, n_tokens,
    copies (how often the mixture holds it), leaf_target, epoch_tokens (where
    the row ends in the order of the leaf's last, cut epoch); with ``carry``, the
    row's own columns of those names as the struct ``row``."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in carry]
    more = [F.xxhash64(*own).alias("__h"), F.struct(*own).alias("__row")] if own else []
    ties, out = (["__h"], [F.col("__row").alias("row")]) if own else ([], [])
    rows = staged(
        docs.select(F.col(id_col).alias("__id"), name(domain).alias(LEVELS[0]), name(lang).alias(LEVELS[1]), name(source).alias(LEVELS[2]), tokens.cast("long").alias("__t"), *more),
        "mixing",
    )
    leaves = staged(rows.groupBy(*LEVELS).agg(F.sum("__t").alias("__tokens"), F.count(F.lit(1)).alias("__rows")), "leaves")
    plan = staged(plan_leaves(leaves, budget, max_epochs, weights or {}), "plan")

    ident = F.coalesce(F.col("__id").cast("string"), F.col("__h").cast("string")) if own else F.col("__id")
    keyed = rows.join(plan, list(LEVELS)).withColumn("__k", order_key(seed, F.col("__epochs"), ident))
    keyed = keyed.withColumn("__cell", F.expr(f"shiftright(__k, {KEY_BITS} - __bits)"))
    before = Window.partitionBy(*LEVELS).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy(*LEVELS, "__cell").agg(F.sum("__t").alias("__sum"))
    cells = cells.select(*LEVELS, "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*LEVELS, "__cell").orderBy("__k", "__id", "__t", *ties).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__start") + F.sum("__t").over(inside)
    return (
        keyed.join(cells, [*LEVELS, "__cell"])
        .withColumn("__upto", upto)
        .select(
            F.col("__id").alias(id_col),
            F.col("__l0").alias("domain"),
            F.col("__l1").alias("lang"),
            F.col("__l2").alias("source"),
            F.col("__t").alias("n_tokens"),
            (F.col("__epochs") + F.when((F.col("__upto") <= F.col("__rest")) & (F.col("__rest") > 0), 1).otherwise(0)).cast("long").alias("copies"),
            F.col("__target").cast("long").alias("leaf_target"),
            F.col("__upto").cast("long").alias("epoch_tokens"),
            *out,
        )
    )
