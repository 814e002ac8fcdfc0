"""Licence scan in DataFrame functions only: one narrow pass over the text, no Python, no shuffle.

Gate words, looked for once white space is made single blanks, decide which texts can hold anything; the rest only get their words counted.
A gated text is lower-cased (A-Z alone), its white space too made single blanks; its rules are picked by their gate words, each picked rule's
places are found, and an ordered sweep drops every detection that lies inside one of at least its rank.

Defined cases: a null text is empty; an empty text has no words, places or labels and score 0; repeated
rows are judged each on its own; other columns of the input are ignored whatever they are called.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.license_rules import GATE, rules

#: What stands between words: ASCII but letters and digits. Splitting on it is far cheaper than extracting its complement.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: White space but a single blank.
WRAPS = r"[\t-\r]\s*| \s+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}


def _rule_table() -> Column:
    """The rules by keyword as one constant array, which the optimiser folds into a literal."""
    by: dict[str, list[dict]] = {}
    for i, (label, priority, score, word, rx) in enumerate(rules()):
        by.setdefault(word, []).append({"rule": i, "label": label, "priority": priority, "score": score, "rx": rx})
    rows = [{"keyword": word, "rules": found} for word, found in by.items()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,rules:array<struct<rule:int,label:string,priority:int,score:double,rx:string>>>>")


def _places(low: Column, r: Column) -> Column:
    """All matches of one rule as structs with start and end (in characters), in order."""
    zipped = F.arrays_zip(F.split(low, r["rx"], -1).alias("gap"), F.regexp_extract_all(low, r["rx"], F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.when(x["hit"].isNotNull(), F.array_append(acc["found"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(zipped, start, step, lambda a: a["found"])


def detections(low: Column) -> Column:
    """Array of (start, end, -priority order keys, label, score) for every place of every rule whose keyword occurs."""
    picked = F.flatten(F.transform(F.filter(_rule_table(), lambda g: F.contains(low, g["keyword"])), lambda g: g["rules"]))  # each keyword is looked for once
    per_rule = F.transform(picked, lambda r: F.transform(_places(low, r), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score"))))
    return F.array_sort(F.flatten(per_rule))


def _sweep(found: Column) -> Column:
    """Labels and best score of the detections left by suppression; `found` is ordered by start, then longest, then priority."""
    empty = F.struct(
        F.array().cast("array<struct<end:int,priority:int>>").alias("open"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        still = F.filter(acc["open"], lambda o: o["end"] > d["start"])
        inside = F.exists(still, lambda o: (o["end"] >= end) & (o["priority"] >= priority))
        kept = F.array_append(still, F.struct(end.alias("end"), priority.alias("priority")))
        return F.struct(
            F.when(inside, still).otherwise(kept).alias("open"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["score"])).alias("score"),
        )

    return F.aggregate(found, empty, step)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flat = slim.select("*", F.regexp_replace(F.lower("text"), WRAPS, " ").alias("flat"))  # a column of its own, computed once for all gate words
    gate = reduce(or_, [F.contains("flat", F.lit(word)) for word in GATE])
    low = F.regexp_replace(F.translate("text", UPPER, SMALL), WRAPS, " ")
    parts = flat.select("doc_id", F.split("text", BREAK, -1).alias("parts"), F.when(gate, low).alias("low"))
    edges = sum(F.when(F.get("parts", i) == "", 1).otherwise(0) for i in (F.lit(0), F.size("parts") - 1))
    counted = parts.select("doc_id", F.greatest(F.size("parts") - edges, F.lit(0)).cast("bigint").alias("n_words"), "low")
    words = counted.select("*", F.array_remove(F.split("low", BREAK, -1), "").alias("words"), F.when(F.col("low").isNotNull(), _sweep(detections(F.col("low")))).alias("swept"))

    def at(phrase: tuple[str, ...], i: Column) -> Column:
        hit = F.lit(True)
        for k, word in enumerate(phrase):
            hit = hit & F.coalesce(F.get("words", i + k) == word, F.lit(False))
        return hit

    def starts(phrase: tuple[str, ...]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: at(phrase, i))

    places = {label: F.when(F.col("low").contains("license"), starts(phrase)) for label, phrase in PHRASES.items()}
    placed = words.select("doc_id", "n_words", "swept", *[p.alias(f"at_{label}") for label, p in places.items()])
    every = F.sort_array(F.concat(*[F.coalesce(F.col(f"at_{label}"), F.array().cast("array<int>")) for label in PHRASES]))
    base = F.array_compact(F.array(*[F.when(F.size(F.coalesce(F.col(f"at_{label}"), F.array().cast("array<int>"))) > 0, F.lit(label)) for label in PHRASES]))
    none = F.array().cast("array<string>")
    return placed.select("doc_id", "n_words", "swept", every.alias("every"), F.coalesce(base, none).alias("base")).select(
        "doc_id",
        "n_words",
        F.size("every").cast("bigint").alias("n_base"),
        F.get("every", F.lit(0)).cast("bigint").alias("first_word"),
        F.get("every", F.size("every") - 1).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.coalesce("swept.labels", none)))), ",").alias("labels"),
        F.coalesce("swept.score", F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
