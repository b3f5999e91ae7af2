"""Positioned text into lines and columns, and a program's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .finance import clean

#: Fixed: how far a fragment may lie from a column's centre, and how far fragments of one line lie from its first.
RADIUS, GAP = 8.5, 3.0
#: Fixed: a line that begins so, or follows such an end, is joined by a blank.
BEGINS = ["м.", "ул.", "г.", "д.", "(в", "в ", "на ", "от ", "до ", "№"]
ENDS = [".", ")", "»"]


def amount_fragment(text: Column) -> Column:
    """Digits, blanks, points and commas only."""
    return clean(text).rlike(r"^[\d\s,.]+$")


def nearest_column(fragments: DataFrame, centres: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Fragments (kind, x) with col, the column whose centre is nearest within the radius, the lower on ties; others go.

    centres: kind, col, centre. They meet as one array a kind, so a fragment stays one row.
    """
    every = centres.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("centre", "col"))).alias("__c"))
    near = F.transform(F.filter("__c", lambda c: F.abs(c["centre"] - F.col("x")) <= radius), lambda c: F.struct(F.abs(c["centre"] - F.col("x")).alias("d"), c["col"].alias("col")))
    return fragments.join(every, "kind").withColumn("__n", F.array_min(near)).where("__n is not null").withColumn("col", F.col("__n.col")).drop("__c", "__n")


def text_lines(placed: DataFrame, by: list[str], gap: float = GAP) -> DataFrame:
    """By, line_no and text of each line, top to bottom: a fragment begins a line if it lies more than the gap from the first of the line before.

    A group is what one place of a page holds. Fragments of a line are joined from left to right; those of equal places by text.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text")))
    empty = F.array().cast("array<struct<down:double,parts:array<struct<x:double,text:string>>>>")

    def put(lines: Column, item: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        part = F.array(F.struct(item["x"].cast("double").alias("x"), item["text"].alias("text")))
        same = F.coalesce(F.abs(last["down"] - item["down"]) <= gap, F.lit(False))
        longer = F.struct(last["down"].alias("down"), F.concat(last["parts"], part).alias("parts"))
        fresh = F.struct(item["down"].cast("double").alias("down"), part.alias("parts"))
        return F.when(same, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(fresh)))

    lines = placed.groupBy(*by).agg(items.alias("items")).select(*by, F.posexplode(F.aggregate("items", empty, put)).alias("line_no", "line"))
    return lines.select(*by, "line_no", F.array_join(F.transform(F.array_sort("line.parts"), lambda p: p["text"]), "").alias("text"))


def cell_texts(lines: DataFrame, by: list[str]) -> DataFrame:
    """The lines of text_lines() as one text a group, joined by nothing or, where a word ends, by a blank."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("t")))), lambda x: x["t"])

    def join(text: Column, line: Column) -> Column:
        low = F.lower(line)
        blank = F.lit(False)
        for b in BEGINS:
            blank = blank | low.startswith(b)
        for e in ENDS:
            blank = blank | F.rtrim(text).endswith(e)
        return F.when(line == "", text).when(text == "", line).when(blank, F.concat(text, F.lit(" "), line)).otherwise(F.concat(text, line))

    return lines.groupBy(*by).agg(texts.alias("t")).select(*by, F.aggregate("t", F.lit(""), join).alias("text"))


def column_amounts(placed: DataFrame, by: list[str]) -> DataFrame:
    """The amount of each group and col: its fragments of digits from the top down and left to right, as one number; null if it is none."""
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text"))), lambda i: i["text"])
    raw = F.regexp_replace(F.array_join(items, ""), r"[^\d,.]", "")
    found = placed.where(amount_fragment(F.col("text"))).groupBy(*by, "col").agg(raw.alias("raw"))
    return found.select(*by, "col", F.translate("raw", ",", ".").try_cast("decimal(20,2)").alias("amount"))


def program_description(paragraphs: DataFrame) -> DataFrame:
    """doc_id, name, period_start, period_end, from paragraphs that speak of a municipal program, in order until both are known.

    The name is the first in quotes of either kind; of several periods before the name the last counts. A document without any has no row.
    """
    low = F.lower(clean(F.col("text")))
    about = paragraphs.where(low.contains("муницип") & low.contains("программ"))
    name = F.nullif(F.trim(F.regexp_extract(clean(F.col("text")), r"[«\"]([^»\"]+)[»\"]", 1)), F.lit(""))
    years = [F.regexp_extract(clean(F.col("text")), r"\b(20\d{2})\s*[-–]\s*(20\d{2})\b", i).try_cast("int") for i in (1, 2)]
    p = about.select("doc_id", "para_idx", name.alias("name"), F.when(years[0].isNotNull(), F.struct(years[0].alias("a"), years[1].alias("b"))).alias("span"))
    at = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("para_idx")))
    stop = p.groupBy("doc_id").agg(at("name").alias("n"), at("span").alias("s")).select("doc_id", F.when(F.col("n").isNotNull() & F.col("s").isNotNull(), F.greatest("n", "s")).alias("stop"))
    read = p.join(stop, "doc_id").where("stop is null or para_idx <= stop")
    out = read.groupBy("doc_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("para_idx"))).alias("name"), F.max_by("span", F.when(F.col("span").isNotNull(), F.col("para_idx"))).alias("span"))
    return out.where("name is not null or span is not null").select("doc_id", "name", F.col("span.a").alias("period_start"), F.col("span.b").alias("period_end"))
