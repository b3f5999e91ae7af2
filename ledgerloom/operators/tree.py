"""Tree operators: closures, roll-ups, summaries, numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import settled

MONEY = "decimal(20,2)"
KEY = ["year", "source_type"]


def total(column: str | Column = "amount") -> Column:
    return F.sum(column).cast(MONEY)


def link_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with has_parent, whether parent_id names a node."""
    up = nodes.select(F.col("node_id").alias("__up")).distinct()
    return nodes.join(up, F.col("parent_id") == F.col("__up"), "left").withColumn("has_parent", F.col("__up").isNotNull()).drop("__up")


def attach_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of known nodes; the others are dropped."""
    return lines.join(nodes.select("node_id").distinct(), "node_id")


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, depth, each node included as its own ancestor at depth 0; a tree of any depth.

    Steps double: those up to k and those of just k make those up to 2k, so a tree of depth d takes log2(d) rounds, each settled. The
    last round finds nothing. A node above itself is an error that names it.
    """
    steps = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    found, k = settled(steps), 1
    while True:
        refuse_cycles(found)
        jumps = found.where(F.col("depth") == k).select("node_id", F.col("ancestor_id").alias("__mid"))
        further = found.select(F.col("node_id").alias("__mid"), "ancestor_id", (F.col("depth") + k).alias("depth"))
        longer = settled(jumps.join(further, "__mid").select("node_id", "ancestor_id", "depth"))
        if longer.isEmpty():
            break
        found, k = found.unionByName(longer), 2 * k
    return found.unionByName(nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth")))


def closure_counts(nodes: DataFrame) -> DataFrame:
    """P4 by ancestor: how many nodes lie in its subtree (n), itself included, and how deep the deepest one."""
    return ancestor_closure(nodes).groupBy("ancestor_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def refuse_cycles(steps: DataFrame) -> None:
    """An error if some node is its own ancestor."""
    caught = steps.where("node_id = ancestor_id").agg(F.min("node_id").alias("node_id")).first().node_id
    if caught is not None:
        raise ValueError(f"the parents of node {caught} lead back to it")


def aggregate_lines(lines: DataFrame, by: str = "node_id") -> DataFrame:
    """Amounts by node, year and source."""
    return lines.groupBy(by, *KEY).agg(total().alias("amount"))


#: Levels after which a roll-up looks whether the tree is one.
TALL = 32


def roll_up(amounts: DataFrame, nodes: DataFrame, owners: DataFrame | None = None, columns: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Sums by node, year and source of each node's own amounts and of all below it, of each of the columns; amounts of unknown nodes go.
    A tree of any depth. If owners (node_id) are given, only their own amounts count.

    Each level's sums are settled and then go to the parents; they are far fewer than the amounts, so no ancestor list is made. Nodes
    without children, nearly all of a tree, are done with the first level; the others alone are met by the next ones and summed again.
    The loop ends with the level that has nothing above it. Parents that lead back to a node are an error.
    """
    sums = [total(c).alias(c) for c in columns]
    above = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("__above", F.lit(True))
    # a node that is there twice is summed again too
    again = F.col("__above").isNotNull() | (F.count("*").over(W.partitionBy("node_id")) > 1)
    up = nodes.select("node_id", F.col("parent_id").alias("__up")).join(above, "node_id", "left").withColumn("__again", again).drop("__above")
    level = amounts.groupBy("node_id", *KEY).agg(*sums)
    first = settled(level.join(up if owners is None else up.join(owners, "node_id", "left_semi"), "node_id"))
    known, every, n = first, [first.where("__again")], 1
    inner = settled(up.where("__again").drop("__again"))
    while True:
        level = known.where("__up is not null").groupBy(F.col("__up").alias("node_id"), *KEY).agg(*sums)
        known = settled(level.join(inner, "node_id"))
        if known.isEmpty():
            break
        every.append(known)
        n += 1
        if n == TALL:
            ancestor_closure(nodes)
    out = ["node_id", *KEY, *columns]
    return first.where("not __again").select(*out).unionByName(reduce(DataFrame.unionByName, (x.select(*out) for x in every)).groupBy("node_id", *KEY).agg(*sums))


def rollup_inclusive(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node's own lines and those of all below it."""
    return roll_up(lines, nodes)


def rollup_replace(nodes: DataFrame, lines: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Leaves keep their lines, a node with regular children has their sum and loses its own lines.

    Nothing passes through an excluded node: what lies below it counts up to it, and not for it or those above.
    """
    regular = nodes if excluded is None else nodes.where(~F.coalesce(excluded, F.lit(False)))
    parents = regular.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    leaves = regular.select("node_id").join(parents, "node_id", "left_anti")
    if excluded is not None:
        hidden = nodes.where(F.coalesce(excluded, F.lit(False))).select(F.col("node_id").alias("__hidden")).distinct()
        regular = regular.join(hidden, F.col("parent_id") == F.col("__hidden"), "left").withColumn("parent_id", F.when(F.col("__hidden").isNull(), F.col("parent_id")))
    return roll_up(lines, regular, leaves)


def root_totals(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The program node's own lines if it has any, else the roots' totals."""
    roots = nodes.where("parent_id is null").select("node_id", "node_type")
    mine = lines.join(roots, "node_id")
    has = mine.where("node_type = 'program'").agg((F.count("*") > 0).alias("has"))
    return mine.crossJoin(F.broadcast(has)).where("not has or node_type = 'program'").groupBy(*KEY).agg(total().alias("amount"))


#: Descendants from which on an ancestor is sent to all tasks; there is at most one in so many rows of a closure.
CROWDED = 100_000


def hierarchy_struct(nodes: DataFrame, closure: DataFrame, types: list[str], crowded: int = CROWDED) -> DataFrame:
    """The nearest ancestor's name of each type, a column a type.

    Roots have all nodes below them, so the few ancestors with very many are broadcast, and no task gets all their descendants.
    """
    named = nodes.select(F.col("node_id").alias("ancestor_id"), "node_type", "name")
    many = settled(closure.groupBy("ancestor_id").agg(F.count("*").alias("n")).where(F.col("n") >= crowded).select("ancestor_id").join(named, "ancestor_id"))
    few = closure.join(F.broadcast(many.select("ancestor_id").distinct()), "ancestor_id", "left_anti").join(named, "ancestor_id")
    every = few.unionByName(closure.join(F.broadcast(many), "ancestor_id").select(few.columns))
    of = lambda t: F.min_by(F.when(F.col("node_type") == t, F.col("name")), F.when(F.col("node_type") == t, F.col("depth"))).alias(t)
    return every.groupBy("node_id").agg(*(of(t) for t in types))


def hierarchy_path(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """J9: "number name" labels from the root to the node."""
    label = F.concat_ws(" ", "display_number", "name")
    named = closure.join(nodes.select(F.col("node_id").alias("ancestor_id"), label.alias("label")), "ancestor_id")
    path = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "label")))
    return named.groupBy("node_id").agg(F.transform(path, lambda x: x["label"]).alias("path"))


def carry_down(rows: DataFrame, value: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """The last non-null value above, its own row included."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def mirror_authority(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of equal rows the authority: with children first, then the largest absolute sum, then the first row."""
    w = W.partitionBy(*by).orderBy(F.desc("has_children"), F.desc("weight"), "row_idx", "node_id")
    return rows.withColumn("authority_id", F.first("node_id").over(w)).withColumn("is_mirror", F.col("node_id") != F.col("authority_id"))


def sync_mirrors(totals: DataFrame, authority: DataFrame) -> DataFrame:
    """Mirrors take their authority's totals; other nodes keep theirs."""
    mirrors = authority.where("is_mirror").select("node_id", "authority_id")
    own = totals.join(mirrors.select("node_id"), "node_id", "left_anti")
    given = mirrors.join(totals.withColumnRenamed("node_id", "authority_id"), "authority_id").select("node_id", *KEY, "amount")
    return own.select("node_id", *KEY, "amount").unionByName(given)


def table_local_total(rows: DataFrame, by: list[str], order: list[str], out: str = "total_above") -> DataFrame:
    """The sum of all rows above in the same table, not only since the last total; zero for the first."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum("amount").over(w), F.lit(0)).cast(MONEY))


def next_sibling_number(children: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (parent_id, seq) get the numbers after their parent's last child."""
    last = children.groupBy("parent_id").agg(F.max(F.element_at(F.split("display_number", r"\."), -1).cast("int")).alias("last"))
    at = F.row_number().over(W.partitionBy("parent_id").orderBy("seq"))
    return new.join(last, "parent_id", "left").withColumn("number", F.coalesce("last", F.lit(0)) + at).drop("last")


def renumber_siblings(rows: DataFrame, parent: str, code: str, order: list[str]) -> DataFrame:
    """Siblings numbered by code, then order; rows of one code share a number."""
    first = F.min(F.struct(*order)).over(W.partitionBy(parent, code))
    return rows.withColumn("__first", first).withColumn("number", F.dense_rank().over(W.partitionBy(parent).orderBy(code, "__first"))).drop("__first")


def propagate_deltas(lines: DataFrame, deltas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Totals (node, year, source) with the deltas of a node added to it and to all above it."""
    up = roll_up(deltas.withColumnRenamed("delta", "amount"), nodes).withColumnRenamed("amount", "delta")
    joined = lines.join(up, ["node_id", *KEY], "full_outer")
    return joined.select("node_id", *KEY, (F.coalesce("amount", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast(MONEY).alias("amount"))


def propagated_and_recomputed(lines: DataFrame, deltas: DataFrame, nodes: DataFrame) -> DataFrame:
    """P12 beside G5: per node, year and source the totals of the lines with the deltas that went up the tree added to them (amount), and
    what the changed lines give when they are rolled up (again). All three go up at once, a column each, so the tree is climbed once."""
    none = F.lit(None).cast(MONEY)
    was = lines.select("node_id", *KEY, F.col("amount").cast(MONEY).alias("amount"), none.alias("delta"), F.col("amount").cast(MONEY).alias("again"))
    new = deltas.select("node_id", *KEY, none.alias("amount"), F.col("delta").cast(MONEY).alias("delta"), F.col("delta").cast(MONEY).alias("again"))
    up = roll_up(was.unionByName(new), nodes, columns=("amount", "delta", "again"))
    return up.select("node_id", *KEY, (F.coalesce("amount", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast(MONEY).alias("amount"), "again")


def refresh_summaries(summaries: DataFrame, totals: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Summary rows (node_id, refers_to) take the totals of the node that they refer to.

    Rows that refer to no node with totals take `local` (node_id, year, source_type, amount), the sums of their table so far (W5).
    """
    given = summaries.join(totals.withColumnRenamed("node_id", "refers_to"), "refers_to").select("node_id", *KEY, "amount")
    if local is None:
        return given
    rest = summaries.select("node_id").join(given.select("node_id").distinct(), "node_id", "left_anti")
    return given.unionByName(local.join(rest, "node_id", "left_semi").select("node_id", *KEY, "amount"))


def rebase_root(baseline: DataFrame, deltas: DataFrame) -> DataFrame:
    """A root without lines: the passport's amounts and the deltas."""
    d = deltas.groupBy(*KEY).agg(total("delta").alias("delta"))
    joined = baseline.join(d, KEY, "full_outer")
    return joined.select(*KEY, (F.coalesce("amount", F.lit(0)) + F.coalesce("delta", F.lit(0))).cast(MONEY).alias("amount"))


def close_to_target(actual: DataFrame, expected: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Adjustment lines for root keys that differ by more than the tolerance."""
    joined = expected.withColumnRenamed("amount", "e").join(actual.withColumnRenamed("amount", "a"), KEY, "full_outer")
    delta = (F.coalesce("e", F.lit(0)) - F.coalesce("a", F.lit(0))).cast(MONEY)
    return joined.select(F.lit("ADJUSTMENT").alias("node_id"), *KEY, delta.alias("amount")).where(F.abs("amount") > tolerance)


def closed_root(actual: DataFrame, expected: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """P16's second roll-up: the root's totals with its adjustment lines."""
    both = actual.select(*KEY, "amount").unionByName(close_to_target(actual, expected, tolerance).select(*KEY, "amount"))
    return both.groupBy(*KEY).agg(total().alias("amount"))


def aggregate_parent_fix(totals: DataFrame, aggregates: DataFrame, nodes: DataFrame) -> DataFrame:
    """New aggregates (node_id is the blank parent) replace its totals; the difference goes up."""
    mine = totals.withColumnRenamed("amount", "old")
    delta = aggregates.join(mine, ["node_id", *KEY], "left").select("node_id", *KEY, (F.col("amount") - F.coalesce("old", F.lit(0))).cast(MONEY).alias("delta"))
    return propagate_deltas(totals, delta, nodes)


def subtree_dates(closure: DataFrame, lines: DataFrame) -> DataFrame:
    """T20 for every node: "first" or "first-last" of its years with money."""
    years = lines.where("amount <> 0").select("node_id", "year").distinct().join(closure, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return years.select("node_id", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b")).alias("execution_period"))
