"""Array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import parse_funding_key, token_core


def funding_map_to_rows(df: DataFrame, column: str) -> DataFrame:
    """Map entries keyed "year::source" as rows; keys without a year are dropped."""
    out = df.withColumn("__e", F.explode(F.map_entries(column)))
    return out.withColumns({"year": parse_funding_key(F.col("__e.key"))["year"], "source_type": parse_funding_key(F.col("__e.key"))["source_type"], "amount": F.col("__e.value")}).where("year is not null").drop("__e", column)


def first_nonblank(cells: Column, predicate) -> Column:
    """Of cells (header, text) in order the first text that is not blank under a header that the predicate takes."""
    found = F.filter(cells, lambda x: predicate(x["header"]) & (F.trim(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.try_element_at(found, F.lit(1))["text"]


def cored(tokens: Column) -> Column:
    """Tokens as structs with their cores, so that a comparison of many pairs makes each core once."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), token_core(t).alias("core")))


def tokens_match(a: Column, b: Column, cores: tuple[Column, Column] | None = None) -> Column:
    """Equal, same core, a core of five letters that begins the other, or three quarters of the shorter one in common."""
    ca, cb = cores or (token_core(a), token_core(b))
    short = F.least(F.char_length(a), F.char_length(b))
    k = F.ceil(short * 0.75).cast("int")
    starts = (F.char_length(ca) >= 5) & b.startswith(ca) | (F.char_length(cb) >= 5) & a.startswith(cb)
    return (a == b) | (ca == cb) | starts | (short >= 6) & (F.left(a, k) == F.left(b, k))


def token_overlap_any(left: Column, right: Column) -> Column:
    """Left tokens that begin, or are begun by, some right token."""
    return F.size(F.filter(left, lambda a: F.exists(right, lambda b: (a == b) | a.startswith(b) | b.startswith(a))))


def token_overlap_greedy(left: Column, right: Column, with_cores: bool = False) -> Column:
    """One-to-one matches, left to right, each with the first unused right token."""
    same = (lambda a, b: tokens_match(a["token"], b["token"], (a["core"], b["core"]))) if with_cores else tokens_match
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("n"))

    def step(acc: Column, a: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(right)), lambda i: ~F.array_contains(acc["used"], i) & same(a, F.element_at(right, i)))
        hit = F.try_element_at(places, F.lit(1))
        return F.when(hit.isNotNull(), F.struct(F.array_append(acc["used"], hit).alias("used"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.aggregate(left, start, step)["n"]).otherwise(0)


def name_similarity(left: Column, right: Column, with_cores: bool = False) -> Column:
    """D8's score: the larger of overlap / longer and 0.98 overlap / left."""
    n = token_overlap_greedy(left, right, with_cores)
    return F.greatest(n / F.greatest(F.size(left), F.size(right), F.lit(1)), 0.98 * n / F.greatest(F.size(left), F.lit(1)))


def compact_struct(*columns: str) -> Column:
    """The fields that are not null, as JSON."""
    return F.to_json(F.struct(*columns))


def to_jsonable(*columns: str) -> Column:
    """All values as strings."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)))


def merge_summary(left: Column, right: Column) -> Column:
    """Map entries of both, the right one's where both have a key."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
