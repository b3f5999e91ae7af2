"""A Merkle manifest of a dataset: leaves, subroots by source, one root, and a proof a row.

Nodes have a rank. Its digits in base three are columns, and one digit after another is grouped away: the structs of a run become the
children of a struct that has the run's hash. That goes on within blocks of ARITY ** DIGITS nodes, so a struct is never larger than a
block; the blocks' hashes are the nodes of the next tier. On the way back each tier unfolds its blocks by transform and explode, and
what lies beside a node's way to the root comes along. A block meets the proof of its own hash by grouping both under the block's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, settled

ARITY, DIGITS = 3, 4
BLOCK = ARITY**DIGITS

#: A level of a proof: the hashes before and after the node in its run, as one text each.
STEP = "array<struct<left:string,right:string>>"


def field(column: Column) -> Column:
    """A value with its length in bytes; - if null."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value))


def leaf(text: str | Column = "text") -> Column:
    values = (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text if isinstance(text, Column) else F.col(text))
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row's text loses its line ends: an even checksum of doc_id; rows without a doc_id are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with pos, its place from 0 in its group by the order, and total, the group's size.

    Rows are laid out by ranges of (group, order), so a large group lies in many partitions; a row's place is its place in its
    partition and the sizes of the partitions before it, of which there are as many rows as partitions and groups.
    """
    by = [F.asc_nulls_first(group), *order]
    laid = df.repartitionByRange(parts(df), *by).sortWithinPartitions(*by)
    # the number grows along a partition, from partition << 33
    laid = settled(laid.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    sizes = laid.groupBy(F.col(group).alias("__g"), "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    w = W.partitionBy("__g")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__g", F.col("__part").alias("__p"), (before - F.col("__from")).alias("__shift"), F.sum("__n").over(w).alias("total"))
    met = laid.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift", "__g", "__p")


def tier(nodes: DataFrame) -> DataFrame:
    """nodes (grp, pos, total, hash, payload) to blocks (grp, pos, total, hash, node), counted in blocks; node is the nested struct.

    A level is hashed while its group has several nodes: runs of one as well, but not the last node.
    """
    digits = [f"__{i}" for i in range(DIGITS)]
    rows = nodes.select("grp", F.expr(f"pos div {BLOCK}").alias("pos"), "total", *(F.expr(f"pos div {ARITY**i} % {ARITY}").cast("int").alias(d) for i, d in enumerate(digits)), F.struct("hash", "payload").alias("node"))
    rows = rows.repartition(parts(nodes), "grp", "pos")  # all groupings below have it
    for i, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "node")))
        rows = rows.groupBy("grp", "pos", "total", *digits[i + 1 :]).agg(kids.alias("kids"))
        several = F.col("total") > ARITY**i
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["hash"]), ""), 256)
        rows = rows.select("grp", "pos", "total", *digits[i + 1 :], F.struct(F.when(several, joined).otherwise(F.col("kids")[0]["node"]["hash"]).alias("hash"), F.transform("kids", lambda k: k["node"]).alias("kids")).alias("node"))
    return rows.select("grp", "pos", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("total").alias("below"), F.col("node.hash").alias("hash"), "node")


def unfolded(blocks: DataFrame) -> DataFrame:
    """blocks (grp, pos, below, node, above, root, subroot) to the nodes they hold (grp, pos, hash, payload, above, root, subroot); above are a node's steps to the root, the lowest first."""

    def steps(kids: Column, i: Column, above: Column, level: int) -> Column:
        side = lambda part: F.array_join(F.transform(part, lambda k: k["hash"]), "")
        here = F.array(F.struct(side(F.slice(kids, 1, i)).alias("left"), side(F.slice(kids, i + 2, ARITY)).alias("right")))
        return F.concat(F.when(F.col("below") > ARITY**level, here).otherwise(F.array().cast(STEP)), above)

    def walk(kids: Column, above: Column, place: Column, level: int) -> Column:
        if not level:
            return F.transform(kids, lambda k, i: F.struct((place * ARITY + i).alias("pos"), k["hash"].alias("hash"), k["payload"].alias("payload"), steps(kids, i, above, 0).alias("above")))
        return F.flatten(F.transform(kids, lambda k, i: walk(k["kids"], steps(kids, i, above, level), place * ARITY + i, level - 1)))

    found = blocks.select("grp", F.explode(walk(F.col("node.kids"), F.col("above"), F.col("pos"), DIGITS - 1)).alias("__x"), "root", "subroot")
    return found.select("grp", "__x.*", "root", "subroot")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks, blocks of blocks and so on, until every group has one block; the number of tiers is the logarithm of the largest group."""
    most, out = nodes.agg(F.max("total")).first()[0] or 0, []
    while not out or most > 1:
        out.append(settled(tier(nodes)))
        nodes = out[-1].select("grp", "pos", "total", "hash", F.lit(None).cast("int").alias("payload"))
        most = -(-most // BLOCK)
    return out


def meet(blocks: DataFrame, proofs: DataFrame) -> DataFrame:
    """blocks with above, root and subroot of the proof of the same (grp, pos), which there is one of each."""
    kind = dict(blocks.dtypes)["node"]
    below = blocks.select("grp", "pos", "below", "node", *(F.lit(None).cast(t).alias(c) for c, t in (("above", STEP), ("root", "string"), ("subroot", "string"))))
    upper = proofs.select("grp", "pos", F.lit(None).cast("long").alias("below"), F.lit(None).cast(kind).alias("node"), "above", "root", "subroot")
    both = below.unionByName(upper).groupBy("grp", "pos")
    return both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("below", "node", "above", "root", "subroot")))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, and n_steps, the levels of its proof.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each `-` if null, else with its length in bytes. Leaves of a source
    ascend by doc_id (nulls first; rows of one doc_id by their leaves, so repeated rows are equal leaves side by side); while there are
    several, each three become their digest. Sources, null first, then give the root alike. The proof is the digest of all that lies
    beside a leaf's way up. folded_root is computed from the proof and the row as it came (tampered() says which rows have lost their
    line ends by then), and verified says whether that is the root. An empty table has no rows. Other columns are not read.
    """
    marked = F.when(tampered(F.col("doc_id")) & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = settled(docs.select("doc_id", F.col("source").alias("grp"), leaf().alias("hash"), marked.alias("came")))
    leaves = ranked(leaves, "grp", [F.asc_nulls_first("doc_id"), F.col("hash")])
    low = tiers(leaves.select("grp", "pos", "total", "hash", F.struct("doc_id", "came").alias("payload")))
    tops = low[-1].select(F.col("grp").alias("source"), F.col("hash")).withColumn("grp", F.lit(0))
    tops = ranked(tops, "grp", [F.asc_nulls_first("source")])
    high = tiers(tops.select("grp", "pos", "total", "hash", F.struct("source").alias("payload")))
    root = high[-1].select("grp", "pos", F.array().cast(STEP).alias("above"), F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot"))
    for blocks in reversed(high):
        root = unfolded(meet(blocks, root))
    proofs = root.select(F.col("payload.source").alias("grp"), F.lit(0).cast("long").alias("pos"), "above", "root", F.col("hash").alias("subroot"))
    for blocks in reversed(low):
        proofs = unfolded(meet(blocks, proofs))
    folded = F.aggregate("above", F.coalesce("payload.came", "hash"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    beside = F.array_join(F.transform("above", lambda s: F.concat(s["left"], s["right"])), "")
    out = proofs.select("payload.doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"), F.size("above").alias("n_steps"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
