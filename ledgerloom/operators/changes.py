"""Change sets: differences, conflicts, resolution, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money as m
from ..functions.text import normalize_mode
from .tree import KEY, MONEY, total

NODE_KEY = ["node_id", *KEY]


def current_amount(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items with old_amount, the sum of their key's lines, zero if there are none."""
    have = lines.groupBy(*NODE_KEY).agg(total().alias("old_amount"))
    return items.join(have, NODE_KEY, "left").withColumn("old_amount", F.coalesce("old_amount", F.lit(0)).cast(MONEY))


def absent_in_target(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Nodes with lines and no match, with their amounts to be zeroed."""
    return lines.join(matched.select("node_id").distinct(), "node_id", "left_anti").groupBy(*NODE_KEY).agg(total().alias("amount"))


def absent_keys(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Of matched nodes the keys that the target does not have."""
    matched = lines.join(entries.select("node_id").distinct(), "node_id", "left_semi")
    return matched.join(entries.select(*NODE_KEY), NODE_KEY, "left_anti").groupBy(*NODE_KEY).agg(total().alias("amount"))


def build_change_set(target: DataFrame, lines: DataFrame) -> DataFrame:
    """Updates, new keys and zeroings by node, year and source; equal amounts give no item."""
    want = target.groupBy(*NODE_KEY).agg(total().alias("new_amount"))
    have = lines.groupBy(*NODE_KEY).agg(total().alias("old_amount"))
    joined = want.join(have, NODE_KEY, "full_outer")
    kind = F.when(F.col("new_amount").isNull(), "zeroing").when(F.col("old_amount").isNull(), "new_key").otherwise("amount_update")
    out = joined.withColumn("change_type", kind)
    for c in ("new_amount", "old_amount"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast(MONEY))
    return out.withColumn("delta", (F.col("new_amount") - F.col("old_amount")).cast(MONEY)).where("delta <> 0")


def detect_conflicts(entries: DataFrame, types: tuple[str, str], order: list[str]) -> DataFrame:
    """Keys where the first entries of two document types differ at all; later entries and sums do not count."""
    firsts = [F.min_by("amount", F.when(F.col("doc_type") == t, F.struct(*order))).cast(MONEY).alias(f"amount_{t}") for t in types]
    a, b = (F.col(f"amount_{t}") for t in types)
    return entries.groupBy(*NODE_KEY).agg(*firsts).where(a.isNotNull() & b.isNotNull() & (a != b))


def conflict_lookup(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Items with has_conflict."""
    return items.join(conflicts.select(*NODE_KEY).distinct().withColumn("__c", F.lit(True)), NODE_KEY, "left").withColumn("has_conflict", F.coalesce("__c", F.lit(False))).drop("__c")


def new_conflicts_only(conflicts: DataFrame, resolved: DataFrame) -> DataFrame:
    """U6."""
    return conflicts.join(resolved.select(*NODE_KEY), NODE_KEY, "left_anti")


def tiny_reallocation(items: DataFrame, tolerance: float = 10.0, noise: float | None = None) -> DataFrame:
    """Keys (node, year) whose several small opposite changes cancel out, to be dropped."""
    limit = noise if noise is not None else max(20 * tolerance, 200.0)
    d = F.col("delta")
    keep = (F.col("n") >= 2) & (F.abs("sum") <= tolerance) & F.col("up") & F.col("down") & (F.col("most") <= limit)
    agg = items.groupBy("node_id", "year").agg(F.count("*").alias("n"), F.sum(d).alias("sum"), F.bool_or(d > 0).alias("up"), F.bool_or(d < 0).alias("down"), F.max(F.abs(d)).alias("most"))
    return agg.where(keep).select("node_id", "year")


def transfer_pair(changes: DataFrame) -> DataFrame:
    """U4: a transfer gives minus its amount in from_year and plus in to_year; without both years it stays one row."""
    both = F.col("from_year").isNotNull() & F.col("to_year").isNotNull()
    pair = F.array(F.struct(F.col("from_year").alias("year"), (-F.col("amount")).cast(MONEY).alias("delta")), F.struct(F.col("to_year").alias("year"), F.col("amount").cast(MONEY).alias("delta")))
    one = F.array(F.struct(F.coalesce("from_year", "to_year").alias("year"), F.col("amount").cast(MONEY).alias("delta")))
    return changes.withColumn("e", F.explode(F.when(both, pair).otherwise(one))).select("change_id", "e.year", "e.delta")


def expand_change_rows(*parts: DataFrame) -> DataFrame:
    """Union of change rows; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def resolve(items: DataFrame) -> DataFrame:
    """P8's last step: resolved, excluded or needs_clarification with a reason, by ordered rules."""
    reason = (
        F.when(F.col("has_conflict"), "conflict")
        .when(F.col("node_id").isNull(), "no_node")
        .when(F.col("year").isNull() | F.col("source_type").isNull(), "no_key")
        .when(F.col("delta") == 0, "no_change")
    )
    status = F.when(reason == "no_change", "excluded").when(reason.isNotNull(), "needs_clarification").otherwise("resolved")
    return items.withColumn("resolution", status).withColumn("reason", reason)


def resolve_policy(items: DataFrame, policy: Column, uploads: DataFrame | None = None) -> DataFrame:
    """Conflicts by a policy, then resolve()'s rules.

    xlsx_over_pdf and pdf_over_xlsx name the document type that wins, latest_uploaded takes the type of the set's newest
    document (uploads: set_id, doc_type, uploaded_at, doc_id). In a conflict the winner's items lose the mark and the others
    are excluded with reason source_priority; a conflict without an item of the winner stays one.
    """
    if uploads is not None:
        newest = uploads.groupBy("set_id").agg(F.max_by("doc_type", F.struct("uploaded_at", "doc_id")).alias("__newest"))
        items = items.join(newest, "set_id", "left")
    else:
        items = items.withColumn("__newest", F.lit(None).cast("string"))
    winner = F.when(policy == "pdf_over_xlsx", "pdf_agreement").when(policy == "latest_uploaded", F.col("__newest")).otherwise("xlsx_finance")
    items = items.withColumn("__winner", winner)
    won = F.bool_or(F.col("doc_type") == F.col("__winner")).over(W.partitionBy("set_id", *NODE_KEY))
    marked = items.withColumn("__settled", F.col("has_conflict") & F.coalesce(won, F.lit(False))).withColumn("__lost", F.col("__settled") & ~F.coalesce(F.col("doc_type") == F.col("__winner"), F.lit(False)))
    out = resolve(marked.withColumn("has_conflict", F.col("has_conflict") & ~F.col("__settled")))
    return out.withColumns({"resolution": F.when(F.col("__lost"), "excluded").otherwise(F.col("resolution")), "reason": F.when(F.col("__lost"), "source_priority").otherwise(F.col("reason"))}).drop("__newest", "__winner", "__settled", "__lost")


def pick_source_priority(items: DataFrame, winner: Column) -> DataFrame:
    """In conflicts the chosen source's items lose the mark, the others are rejected."""
    kept = F.col("has_conflict") & winner
    lost = F.col("has_conflict") & ~winner
    return items.withColumn("status", F.when(lost, "rejected").otherwise(F.col("status"))).withColumn("has_conflict", F.col("has_conflict") & ~kept)


def apply_amounts(lines: DataFrame, items: DataFrame, order: list[str], strict: bool = False) -> DataFrame:
    """P10: an item sets its key's first line and leaves the others; keys without a line get one. strict puts the others to zero.

    Of several items of one key the last by `order` counts (of equal ones the largest amount), so lines keep their number. An
    item without an amount changes nothing.
    """
    first = F.row_number().over(W.partitionBy(*NODE_KEY).orderBy("line_no", "line_id"))
    ranked = lines.withColumn("__rn", first)
    last = F.struct(*order, "new_amount")
    new = items.where("new_amount is not null").groupBy(*NODE_KEY).agg(F.max_by("new_amount", last).cast(MONEY).alias("__new"))
    joined = ranked.join(new, NODE_KEY, "left")
    rest = F.lit(0).cast(MONEY) if strict else F.col("amount")
    amount = F.when(F.col("__new").isNull(), F.col("amount")).when(F.col("__rn") == 1, F.col("__new")).otherwise(rest)
    kept = joined.select(*NODE_KEY, "line_no", amount.alias("amount"))
    added = new.join(lines.select(*NODE_KEY).distinct(), NODE_KEY, "left_anti").select(*NODE_KEY, F.lit(1).alias("line_no"), F.col("__new").alias("amount"))
    return kept.unionByName(added)


def clone_version(nodes: DataFrame, version: str) -> DataFrame:
    """source_node_id, node_id and parent_id of the copy; ids are derived, so no order is needed."""
    new = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(version + ":"), F.col(c)))
    return nodes.select(F.col("node_id").alias("source_node_id"), new("node_id").alias("node_id"), new("parent_id").alias("parent_id"))


def new_object_lines(items: DataFrame, by: str) -> DataFrame:
    """G21."""
    return items.groupBy(by, *KEY).agg(total("new_amount").alias("amount"))


def resolve_parent(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """A new object's parent: by its anchor, else by code, else by main activity, else by a code that one node of the
    tree ends with (a shifted code), of the best stage; activities before main activities, then the lowest node id."""
    kind = F.when(F.col("node_type") == "activity", 0).when(F.col("node_type") == "main_activity", 1).otherwise(2)
    n = nodes.select(F.col("node_id").alias("parent"), "code", "node_type", kind.alias("kind"))
    # a code without its subprogram digits; only such as one node has
    tail = n.where("node_type <> 'object'").select("parent", "kind", F.substring("code", 4, 100).alias("tail")).where("tail <> ''").groupBy("tail").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("kind").alias("kind")).where("n = 1")
    stages = [
        items.join(n.select("parent", "kind"), F.col("anchor") == F.col("parent")),
        items.join(n.select("parent", "kind", "code"), F.col("parent_code") == F.col("code")),
        items.join(n.where("node_type = 'main_activity'").select("parent", "kind", F.col("code").alias("main")), F.col("main_code") == F.col("main")),
        items.join(tail, F.substring(F.coalesce("parent_code", "main_code"), 4, 100) == F.col("tail")),
    ]
    every = [s.select("item_id", "parent", "kind", F.lit(i + 1).alias("stage")) for i, s in enumerate(stages)]
    found = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).groupBy("item_id").agg(F.min(F.struct("stage", "kind", "parent")).alias("b"))
    return items.join(found, "item_id", "left").select("item_id", F.col("b.parent").alias("parent_id"), F.coalesce("b.stage", F.lit(0)).alias("stage"))


def ledger(items: DataFrame) -> DataFrame:
    """Entries with before, operation, delta and expected_after."""
    after = m.new_amount_for_mode(F.col("mode"), F.col("old_amount"), F.col("amount"))
    return items.select("item_id", "set_id", *NODE_KEY, F.col("old_amount").alias("before"), m.operation_code(F.col("mode")).alias("operation"), after.alias("expected_after"), (after - F.col("old_amount")).cast(MONEY).alias("delta"), "status")


def ledger_summary(entries: DataFrame) -> DataFrame:
    """G13's counts and blocking reasons by set."""
    unknown, rejected = F.count_if(F.col("operation") == "unknown"), F.count_if(F.col("status") == "rejected")
    reasons = F.array_compact(F.array(F.when(unknown > 0, "unknown_operation"), F.when(rejected > 0, "rejected_entries")))
    return entries.groupBy("set_id").agg(F.count("*").alias("entries"), rejected.alias("rejected"), F.array_join(reasons, ",").alias("blocking"))


def change_summary(items: DataFrame) -> DataFrame:
    """Counts by status and category."""
    n = lambda c: F.count_if(F.col("status") == c).alias(c)
    return items.groupBy("set_id").agg(F.count("*").alias("n"), *(n(c) for c in ("proposed", "confirmed", "rejected")), F.count_if(F.col("category") == "zeroing").alias("zeroing"), F.count_if(F.col("category") == "new_object").alias("new_object"))


def recalc_by_key(items: DataFrame) -> DataFrame:
    """G16."""
    return items.groupBy(*NODE_KEY).agg(total("old_amount").alias("old_amount"), total("new_amount").alias("new_amount"), total(F.col("new_amount") - F.col("old_amount")).alias("delta"))


def duplicate_updates(items: DataFrame) -> DataFrame:
    """Keys with several active updates."""
    return items.groupBy("set_id", *NODE_KEY).agg(F.count("*").alias("n")).where("n > 1")


def quality_gate(facts: DataFrame, by: str, checks: list[str]) -> DataFrame:
    """A row a check with passed, and ready if all of them passed."""
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("passed")) for c in checks))
    ready = F.forall(pairs, lambda x: x["passed"])
    return facts.select(by, ready.alias("ready"), F.explode(pairs).alias("c")).select(by, "ready", "c.check", "c.passed")


def lifecycle(versions: DataFrame) -> DataFrame:
    """The newest approved version of a program is current, older approved ones are archived."""
    newest = F.max(F.when(F.col("approved"), F.col("version_number"))).over(W.partitionBy("program_id"))
    status = F.when(~F.col("approved"), "draft").when(F.col("version_number") == newest, "current").otherwise("archived")
    return versions.withColumn("status", status)


def reject_drafts(versions: DataFrame, rejected: DataFrame) -> DataFrame:
    """Listed drafts are rejected; what is current or archived stays."""
    marked = versions.join(rejected.select("program_id", "version_number").distinct().withColumn("__r", F.lit(True)), ["program_id", "version_number"], "left")
    return marked.withColumn("status", F.when(F.col("__r") & (F.col("status") == "draft"), "rejected").otherwise(F.col("status"))).drop("__r")


def restore_versions(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """An archived version (the newest chosen one of its program) becomes current again, and what was current is archived."""
    back = versions.where("status = 'archived'").join(chosen, ["program_id", "version_number"], "left_semi").groupBy("program_id").agg(F.max("version_number").alias("__back"))
    marked = versions.join(back, "program_id", "left")
    status = F.when(F.col("version_number") == F.col("__back"), "current").when(F.col("__back").isNotNull() & (F.col("status") == "current"), "archived").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("__back")


def next_version_number(versions: DataFrame) -> DataFrame:
    """W13."""
    return versions.groupBy("program_id").agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"))


def source_mode(docs: DataFrame) -> DataFrame:
    """Which documents of an organization calculate, by the kinds that it has."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    mode = F.when(has("xlsx") & has("pdf"), "target_with_evidence").when(has("xlsx"), "target_only").when(has("pdf"), "patch_only").otherwise("manual_only")
    return docs.groupBy("org_id").agg(mode.alias("mode"))


def source_policy(orgs: DataFrame, docs: DataFrame) -> DataFrame:
    """P6 in full: orgs (org_id, requested, configured, plain_user) and docs (org_id, doc_id, kind, uploaded_at) to the mode, the
    calculating and evidence documents, the roles and the guard against double counting.

    The mode is the requested one, else the organization's (which plain users don't have), else what its documents suggest;
    "auto" always means that. A target has the newest sheet, a patch all agreements, which are evidence beside a target.
    """
    sheets = F.col("kind") == "xlsx"
    have = docs.groupBy("org_id").agg(F.max_by("doc_id", F.when(sheets, F.struct("uploaded_at", "doc_id"))).alias("sheet"), F.sort_array(F.collect_list(F.when(F.col("kind") == "pdf", F.col("doc_id")))).alias("pdfs"))
    both = "xlsx_target_with_pdf_evidence"
    no_docs = F.array().cast("array<bigint>")
    joined = orgs.join(have, "org_id", "left").withColumn("pdfs", F.coalesce("pdfs", no_docs))
    inferred = F.when(F.col("sheet").isNotNull() & (F.size("pdfs") > 0), both).when(F.col("sheet").isNotNull(), "xlsx_target").when(F.size("pdfs") > 0, "pdf_patch")
    asked, own = normalize_mode(F.col("requested")), F.when(~F.col("plain_user"), normalize_mode(F.col("configured")))
    auto = F.coalesce(asked == "auto", own == "auto", F.lit(False))
    mode = F.when(auto, F.coalesce(inferred, F.lit("auto"))).otherwise(F.coalesce(asked, own, inferred, F.lit("auto")))
    out = joined.withColumn("mode", mode)
    target = F.col("mode").isin("xlsx_target", both)
    sheet = F.array_compact(F.array("sheet"))
    return out.select(
        "org_id", "mode",
        F.when(target, sheet).when(F.col("mode") == "pdf_patch", F.col("pdfs")).otherwise(no_docs).alias("calculation_docs"),
        F.when(F.col("mode") == both, F.col("pdfs")).otherwise(no_docs).alias("evidence_docs"),
        F.when(target, "target_model").otherwise("ignored").alias("xlsx_role"),
        F.when(F.col("mode") == both, "evidence").when(F.col("mode") == "pdf_patch", "change_source").otherwise("ignored").alias("pdf_role"),
        F.when(F.col("mode") == both, "pdf_evidence_only").otherwise("single_calculation_source").alias("double_count_guard"),
    )


def reuse_check(sets: DataFrame) -> DataFrame:
    """Whether the last set may be used again."""
    ok = (F.col("unresolved") == 0) & (F.col("duplicates") == 0) & (F.col("status") == "ready") & (F.sort_array("docs") == F.sort_array("wanted_docs"))
    return sets.withColumn("reusable", ok)


def assign_clarified(items: DataFrame, choices: DataFrame) -> DataFrame:
    """Unmatched items take their chosen node; the amount follows S10."""
    joined = items.join(choices.select("item_id", F.col("node_id").alias("chosen")), "item_id", "left")
    new = m.clarified_amount(F.col("mode"), F.col("old_amount"), F.col("amount"), F.col("new_amount"))
    return joined.withColumn("node_id", F.coalesce("node_id", "chosen")).withColumn("new_amount", F.when(F.col("chosen").isNotNull(), new).otherwise(F.col("new_amount"))).drop("chosen")


def confirm_items(items: DataFrame, chosen: DataFrame, safe: Column, expected: DataFrame | None = None) -> DataFrame:
    """Listed items and safe ones are confirmed. With `expected` (set_id, expected): only in sets with just so many of them."""
    marked = items.join(chosen.select("item_id").distinct().withColumn("__c", F.lit(True)), "item_id", "left").withColumn("__c", F.coalesce("__c", F.lit(False)) | safe)
    if expected is not None:
        counted = marked.where("__c").groupBy("set_id").agg(F.count("*").alias("__n"))
        agreed = expected.join(counted, "set_id", "left").where(F.coalesce("__n", F.lit(0)) == F.col("expected")).select("set_id").distinct().withColumn("__ok", F.lit(True))
        marked = marked.join(agreed, "set_id", "left").withColumn("__c", F.col("__c") & F.coalesce("__ok", F.lit(False))).drop("__ok")
    return marked.withColumn("status", F.when(F.col("__c"), "confirmed").otherwise(F.col("status"))).drop("__c")


def without_open_sets(items: DataFrame) -> DataFrame:
    """Resolved items of sets in which nothing needs clarification; the other sets stop."""
    open_sets = items.where("resolution = 'needs_clarification'").select("set_id").distinct()
    return items.where("resolution = 'resolved'").join(open_sets, "set_id", "left_anti")


def result_counts(objects: DataFrame) -> DataFrame:
    """New objects by parent and by the year in which they are completed, their last year with money."""
    done = objects.where("amount <> 0").groupBy("parent_id", "object_id").agg(F.max("year").alias("year"))
    return done.groupBy("parent_id", "year").agg(F.count("*").alias("objects"))


def tenant_defaults(orgs: DataFrame, settings: DataFrame, template: dict) -> DataFrame:
    """An organization's settings over the template's."""
    joined = orgs.join(settings, "org_id", "left")
    return joined.select("org_id", *(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in template.items()))
