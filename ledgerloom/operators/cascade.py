"""The whole matching cascade: eight stages and stored decisions, each over the groups that the stages before have left.

Groups of many programs are matched at once. A group's block is its program with subprogram and activity of its parent's code, or the
whole program where no such code can be read; a node lies in each block that may mean its activity. Every stage is an equi-join on the
block (names by their rarest stems), its answers are settled, and answered groups leave by an anti-join. An ambiguous answer is one too.

groups: group_key (unique), program_id, status (GROUPED_OBJECT, UNASSIGNED_RESIDUAL, ACTIVITY_AGGREGATE), kind (xlsx, pdf), object_code,
object_name, residual_parent_name, event_name, parent_code. funding: group_key, year, source_type, amount. nodes: node_id, program_id,
parent_id, node_type, name, code, codes, display_number, table_index, is_virtual. lines: node_id, year, source_type, amount.
decisions: group_key, node_id, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import concrete_financial_node, summary_row, visible_residual
from ..functions.text import normalize_name_alnum, parse_parent_code
from . import match
from .stages import settled
from .tree import ancestor_closure

ANSWER = ["group_key", "node_id", "match_status", "confidence"]
#: Names that say nothing of a residual's parent, and the code of objects without one.
PLACEHOLDER, NO_CODE = "неуказанное направление", "0000000000.0000000000"


def described(nodes: DataFrame) -> DataFrame:
    """nodes with norm, tokens, is_summary, is_object (a concrete financial node) and is_activity (an activity, or an object that is called one)."""
    out = match.named(nodes, F.col("name")).withColumn("is_summary", F.coalesce(summary_row(F.col("display_number"), F.col("name"), F.col("code")), F.lit(False)))
    called = (F.col("node_type") == "object") & (F.coalesce("code", F.lit("")) != "") & F.col("norm").contains("мероприятие") & ~F.col("is_summary")
    return out.withColumns({
        "is_object": concrete_financial_node(F.col("node_type"), F.col("is_summary"), F.coalesce("is_virtual", F.lit(False))),
        "is_activity": (F.col("node_type") == "activity") | called,
    })


def activities(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Activities with subprogram, its display number or else the table's index, and table_index, their own or their main activity's."""
    above = closure.where("depth > 0").join(nodes.select(F.col("node_id").alias("ancestor_id"), F.col("node_type").alias("t"), F.col("display_number").alias("d"), F.col("table_index").alias("i")), "ancestor_id")
    near = lambda kind, c: F.min_by(F.when(F.col("t") == kind, F.col(c)), F.when(F.col("t") == kind, F.col("depth")))
    near = above.groupBy("node_id").agg(near("subprogram", "d").alias("sub"), near("main_activity", "i").alias("main_index"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    found = nodes.where("is_activity").join(near, "node_id", "left").withColumn("table_index", F.coalesce(blank("table_index"), blank("main_index")))
    return found.withColumn("subprogram", F.coalesce(blank("sub"), F.col("table_index"))).drop("sub", "main_index")


def block(program: Column, subprogram: Column, activity: Column) -> Column:
    return F.concat_ws("|", program, subprogram, activity)


def activity_blocks(found: DataFrame) -> DataFrame:
    """Activity and block: the subprogram is the activity's or one more than its table's index; the activity's code is its own or one within its name."""
    shifted = F.when(F.col("table_index").rlike(r"^[1-9]\d*$"), (F.col("table_index").cast("int") + 1).cast("string"))
    named = F.transform(F.regexp_extract_all("norm", F.lit(r"(?=(\d\d \d\d))"), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit(".")))
    codes = F.array_distinct(F.array_compact(F.array_append(named, F.col("code"))))
    subs = F.array_distinct(F.array_compact(F.array("subprogram", shifted)))
    return found.select("program_id", F.col("node_id").alias("activity_id"), F.explode(subs).alias("s"), codes.alias("c")).select("activity_id", "program_id", "s", F.explode("c").alias("a")).select("activity_id", block(F.col("program_id"), F.col("s"), F.col("a")).alias("block")).distinct()


def node_blocks(nodes: DataFrame, closure: DataFrame, scopes: DataFrame) -> DataFrame:
    """node_id, block: those of the node's activity (itself or the nearest above), and its program as a whole."""
    types = nodes.where("node_type = 'activity'").select(F.col("node_id").alias("ancestor_id"))
    near = closure.where("depth > 0").join(types, "ancestor_id").groupBy("node_id").agg(F.min_by("ancestor_id", "depth").alias("above"))
    mine = nodes.join(near, "node_id", "left").select("node_id", "program_id", F.when(F.col("is_activity"), F.col("node_id")).otherwise(F.col("above")).alias("activity_id"))
    return mine.join(scopes, "activity_id").select("node_id", "block").unionByName(nodes.select("node_id", F.concat("program_id", F.lit("|ALL")).alias("block")))


def group_blocks(groups: DataFrame) -> DataFrame:
    """groups with norm and tokens of object_name, subprogram and activity of the parent's code, and block."""
    code = parse_parent_code(F.col("parent_code"))
    out = match.named(groups, F.col("object_name")).withColumn("__p", code)
    out = out.withColumns({"subprogram": F.col("__p.subprogram"), "activity": F.concat_ws(".", "__p.main", "__p.activity"), "code": F.nullif(F.trim("object_code"), F.lit(""))}).drop("__p")
    return out.withColumn("activity", F.when(F.col("subprogram").isNotNull(), F.col("activity"))).withColumn(
        "block", F.when(F.col("subprogram").isNull(), F.concat("program_id", F.lit("|ALL"))).otherwise(block(F.col("program_id"), F.col("subprogram"), F.col("activity"))))


def answer(found: DataFrame, status: str, confidence: Column | float = 1.0) -> DataFrame:
    return found.select("group_key", "node_id", F.lit(status).alias("match_status"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))


def shown_residual(groups: DataFrame, visible: list[str]) -> DataFrame:
    """Residuals that get a line of their own: no node."""
    name = F.coalesce(F.nullif(F.trim("object_name"), F.lit("")), "residual_parent_name")
    mine = groups.where("status = 'UNASSIGNED_RESIDUAL'").where(visible_residual(normalize_name_alnum(name), visible))
    return answer(mine.withColumn("node_id", F.lit(None).cast("string")), "UNASSIGNED_RESIDUAL", 0.0)


def same_amounts(pairs: DataFrame, funding: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Of pairs (group_key, node_id) those whose amounts agree: each of the group's with the node's sum (0 if none), and no other money in the node's lines."""
    key = ["year", "source_type"]
    wanted = funding.join(pairs.select("group_key").distinct(), "group_key", "left_semi").select("group_key", *key, "amount")
    have = lines.groupBy("node_id", *key).agg(F.sum("amount").alias("have"), (F.max(F.abs("amount")) > tolerance).alias("big"))
    off = pairs.join(wanted, "group_key").join(have, ["node_id", *key], "left").where(F.abs(F.coalesce("have", F.lit(0)) - F.col("amount")) > tolerance).select("group_key", "node_id")
    more = pairs.join(have.where("big"), "node_id").join(wanted, ["group_key", *key], "left_anti").select("group_key", "node_id")
    return pairs.join(off.unionByName(more), ["group_key", "node_id"], "left_anti")


def parent_total(groups: DataFrame, funding: DataFrame, acts: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """The one activity of the parent's code whose amounts are the residual's; those of its subprogram go first, whether they agree or not."""
    mine = groups.where("status = 'UNASSIGNED_RESIDUAL' and subprogram is not null").select("group_key", "program_id", F.col("activity").alias("code"), F.col("subprogram").alias("want"))
    pairs = mine.join(acts.where("node_type in ('activity', 'object')").select("program_id", "code", "node_id", "subprogram"), ["program_id", "code"])
    own = settled(pairs.withColumn("own", F.coalesce(F.col("want") == F.col("subprogram"), F.lit(False))).select("group_key", "node_id", "own"))
    has = own.where("own").select("group_key").distinct()
    pool = own.where("own").unionByName(own.where("not own").join(has, "group_key", "left_anti")).select("group_key", "node_id")
    one = same_amounts(pool, funding, lines, tolerance).groupBy("group_key").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1")
    return answer(one, "MATCH_RESIDUAL_PARENT_TOTAL")


def activity_aggregate(groups: DataFrame, acts: DataFrame) -> DataFrame:
    """The one activity of the subprogram with the code or the display number, or of several the one whose name holds the group's or lies in it."""
    bare = lambda c: normalize_name_alnum(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*мероприятие\s+\d{2}\.\d{2}\.?\s*", ""))
    code = parse_parent_code(F.coalesce(F.nullif(F.trim("parent_code"), F.lit("")), "group_key"))
    mine = groups.where("kind = 'xlsx' and status = 'ACTIVITY_AGGREGATE'").withColumn("__p", code).where("__p is not null")
    keys = F.array(F.concat(F.lit("c"), F.concat_ws(".", "__p.main", "__p.activity")), F.concat(F.lit("d"), F.concat_ws(".", F.col("__p.main").cast("int"), F.col("__p.activity").cast("int"))))
    mine = mine.select("group_key", "program_id", F.col("__p.subprogram").alias("subprogram"), bare(F.col("object_name")).alias("l"), F.explode(keys).alias("k"))
    theirs = acts.where("node_type = 'activity' and not is_summary").select("program_id", "subprogram", "node_id", bare(F.col("name")).alias("r"), F.explode(F.array_compact(F.array(F.concat(F.lit("c"), "code"), F.concat(F.lit("d"), "display_number")))).alias("k"))
    pairs = mine.join(theirs, ["program_id", "subprogram", "k"]).select("group_key", "node_id", ((F.col("l") != "") & (F.col("r") != "") & (F.col("l").contains(F.col("r")) | F.col("r").contains(F.col("l")))).alias("named")).distinct()
    found = pairs.groupBy("group_key").agg(F.count("*").alias("n"), F.min("node_id").alias("one"), F.count_if("named").alias("n_named"), F.min(F.when(F.col("named"), F.col("node_id"))).alias("name"))
    return answer(found.withColumn("node_id", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_named") == 1, F.col("name"))).where("node_id is not null"), "MATCH_ACTIVITY_AGGREGATE")


def residual_parent(groups: DataFrame, structural: DataFrame) -> DataFrame:
    """The node most like the residual's parent name or own name, the former on ties, if it is a concrete one."""
    names = F.array(F.struct(F.lit(0).alias("i"), F.col("residual_parent_name").alias("name")), F.struct(F.lit(1).alias("i"), F.col("object_name").alias("name")))
    mine = groups.where("status = 'UNASSIGNED_RESIDUAL'").select("group_key", "block", F.explode(names).alias("x"))
    mine = match.named(mine, F.col("x.name")).where(~F.col("norm").isin("", PLACEHOLDER)).select("block", F.struct("group_key", "x.i").alias("group_key"), "norm", "tokens")
    asked, names = match.wordings(mine, "norm"), match.distinct_names(structural, "norm", is_object=F.min_by("is_object", "node_id"))
    equal = asked.join(names.select("block", "norm", "node_id"), ["block", "norm"]).select("block", "group_key", "node_id")

    def find(left: DataFrame, share: float) -> DataFrame:
        met = match.stem_pairs(left, names, 3, share - 0.001)
        if share == match.CONTAINED:
            met = met.unionByName(equal).distinct()
        pairs = met.join(left.select("group_key", F.col("norm").alias("ln"), F.col("words").alias("l")), "group_key").join(names.select("block", "node_id", "is_object", F.col("norm").alias("rn"), F.col("words").alias("r")), ["block", "node_id"])
        score = F.when(F.col("ln") == F.col("rn"), 1.0).otherwise(match.likeness())
        return match.spread(pairs).select("group_key", "node_id", "is_object", score.alias("score"))

    best = match.likeliest(asked, find).groupBy("group_key").agg(F.min_by(F.struct("node_id", "is_object", "score"), F.struct(-F.col("score"), "node_id")).alias("b"))
    top = match.answered(mine, asked, best, "norm").groupBy("group_key.group_key").agg(F.min_by("b", F.struct(-F.col("b.score"), "group_key.i", "b.node_id")).alias("b"))
    return answer(top.where("b.is_object").select("group_key", "b.node_id", "b.score"), "MATCH_RESIDUAL_PARENT", F.col("score"))


def event_name(groups: DataFrame, objects: DataFrame) -> DataFrame:
    """An agreement's event in its whole program."""
    mine = match.named(groups.where("kind = 'pdf'").withColumn("block", F.concat("program_id", F.lit("|ALL"))), F.col("event_name")).where("norm <> ''")
    return match.match_event_name(mine, objects.where("norm <> ''"))


def stored_decision(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """The node of a decision stored before; groups of a sheet with all their codes get none."""
    coded = F.coalesce(F.trim("parent_code"), F.lit("")) != ""
    full = coded & (F.coalesce("code", F.lit(NO_CODE)) != NO_CODE) & (F.coalesce(F.trim("object_name"), F.lit("")) != "")
    fixed = (F.col("kind") == "xlsx") & (F.col("status").isin("UNASSIGNED_RESIDUAL", "ACTIVITY_AGGREGATE") & coded | (F.col("status") == "GROUPED_OBJECT") & full)
    found = groups.where(~F.coalesce(fixed, F.lit(False))).select("group_key").join(decisions.where("node_id is not null"), "group_key")
    one = found.groupBy("group_key").agg(F.max_by(F.struct("node_id", "confidence"), F.struct("confidence", "node_id")).alias("b"))
    return answer(one.select("group_key", "b.*"), "MATCH_SEMANTIC_AGENT", F.col("confidence").cast("double"))


def match_groups(groups: DataFrame, funding: DataFrame, nodes: DataFrame, lines: DataFrame, decisions: DataFrame | None = None, visible: list[str] | None = None, threshold: float = match.THRESHOLD, tolerance: float = 0.0) -> DataFrame:
    """Each group's node, match_status, confidence and stage, the stage that answered; groups that no stage answers are
    UNASSIGNED_RESIDUAL or MISSING_IN_DOCX at the last stage. Blank names equal each other inside a block, but not in the whole program."""
    nodes = settled(described(nodes))
    closure = ancestor_closure(nodes)
    acts = settled(activities(nodes, closure))
    held = settled(node_blocks(nodes, closure, activity_blocks(acts)))
    objects = held.join(nodes.where("is_object"), "node_id").select("block", "node_id", "norm", "tokens", F.array_distinct(F.array_append(F.coalesce("codes", F.array().cast("array<string>")), F.col("code"))).alias("codes"))
    structural = held.join(nodes.where("node_type in ('object', 'residual', 'activity', 'main_activity')"), "node_id").select("block", "node_id", "norm", "tokens", "is_object")
    whole = objects.where(F.col("block").endswith("|ALL"))
    groups = settled(group_blocks(groups))
    stages = [
        lambda left: shown_residual(left, visible or []),
        lambda left: parent_total(left, funding, acts, lines, tolerance),
        lambda left: activity_aggregate(left, acts),
        lambda left: residual_parent(left, structural),
        lambda left: match.match_code(left, objects),
        lambda left: match.match_exact_name(left, objects),
        lambda left: match.match_global_name(left.withColumn("block", F.concat("program_id", F.lit("|ALL"))), whole, ("block",)),
        lambda left: match.match_fuzzy(left.where("norm <> ''"), objects, threshold),
        lambda left: event_name(left, whole),
    ]
    if decisions is not None:
        stages.append(lambda left: stored_decision(left, decisions))
    left, answers = groups, []
    for i, stage in enumerate(stages):
        found = settled(stage(left).select(*ANSWER))
        answers.append(found.withColumn("stage", F.lit(i)))
        left = settled(left.join(found.select("group_key"), "group_key", "left_anti"))
    rest = F.when(F.col("status") == "UNASSIGNED_RESIDUAL", F.col("status")).otherwise("MISSING_IN_DOCX")
    missing = left.select("group_key", F.lit(None).cast("string").alias("node_id"), rest.alias("match_status"), F.lit(0.0).alias("confidence"), F.lit(len(stages)).alias("stage"))
    return reduce(DataFrame.unionByName, answers).unionByName(missing)
