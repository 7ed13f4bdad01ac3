"""License scans by ordered signature rules, all in column expressions.

A text's words are runs of ASCII letters and digits (A-Z in lower case) and of characters above ASCII. A rule is tried
where its keyword stands; its matches become word intervals. Of overlapping detections one that lies inside of another
goes, the longer one first and of equal ones the lower rank; detections are swept once in the order of their starts.
The labels are those that remain and those of the base phrases, which always stay. The score is the weight of the
strongest remaining detection.

Null and empty texts have no words, no labels and score 0. Rows that repeat a doc_id are scanned alike. Empty tables
give empty results; other columns are ignored. Every row is scanned where it is read: there is no exchange.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import whole
from folioscan.llm.license_rules import BASE, GATES, Rule, rules

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"
DETECTION = "struct<first:int,last:int,rank:int,label:string,weight:double,base:string>"


RULE = "array<struct<rank:int,label:string,keyword:string,pattern:string,weight:double,base:string>>"


def table(found: list[Rule]) -> Column:
    """The rules as one constant; a match begins with the blank before its first word."""
    rows = [asdict(r) | {"pattern": f" ({r.pattern})(?= )"} for r in found]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


def detections(text: Column, rule: Column) -> Column:
    """Word intervals [first, last] of one rule in a text of single blanks, also around it."""
    marked = F.split(F.regexp_replace(text, rule["pattern"], F.lit(f" {MARK}$1")), " ")
    starts = F.array_compact(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)))
    sizes = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(1)), lambda m: blanks(m) + 1)
    return F.zip_with(starts, sizes, lambda s, n: F.struct(
        (s - 1).cast("int").alias("first"), (s + n - 2).cast("int").alias("last"), rule["rank"].alias("rank"),
        rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"),
    ))


def scanned(text: Column, found: list[Rule]) -> Column:
    """All detections of a text of single blanks."""
    tried = F.filter(table(found), lambda r: F.contains(text, r["keyword"]))
    return F.flatten(F.transform(tried, lambda r: detections(text, r)))


def remaining(spans: Column) -> Column:
    """Labels and strongest weight of the detections that lie in no other: one sweep by start, longest first."""
    order = F.array_sort(F.transform(spans, lambda d: F.struct(
        d["first"].alias("first"), (-d["last"]).alias("back"), d["rank"].alias("rank"), d["label"].alias("label"), d["weight"].alias("weight"),
    )))
    start = F.struct(F.lit(-1).alias("end"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("weight"), F.lit(0).alias("n"))
    return F.aggregate(order, start, lambda acc, d: F.when(-d["back"] <= acc["end"], acc).otherwise(F.struct(
        (-d["back"]).alias("end"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
        F.greatest(acc["weight"], d["weight"]).alias("weight"), (acc["n"] + 1).alias("n"),
    )))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(whole("text"), BETWEEN, " ")), F.lit(" "))
    rows = docs.select("doc_id", padded.alias("words"))
    low = F.lower("words")  # only to see whether a rule can match; wider than A-Z
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(low, F.lit(g))
    rows = rows.select(
        "doc_id", F.when(F.col("words") == "  ", F.lit(0)).otherwise(blanks(F.col("words")) - 1).cast("long").alias("n_words"),
        F.when(gate, F.translate("words", UPPER, LOWER)).alias("words"),
    )
    rows = rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), scanned(F.col("words"), rules())).alias("spans"))
    rows = rows.withColumn("base", F.filter("spans", lambda d: d["base"] != "")).withColumn("left", remaining(F.col("spans")))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["base"])))
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.col("left.labels"))))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size(F.coalesce("base", F.array())), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(every, ","), F.lit("")).alias("labels"),
        F.coalesce("left.weight", F.lit(0.0)).alias("score"),
        F.coalesce("left.n", F.lit(0)).cast("long").alias("n_detections"),
    )


__all__ = ["BASE", "license_scan"]
