"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Each document gets a mask of the filters that it fails.  Per part and label one aggregation makes the 32 signed parity sums
of the masks (their Walsh-Hadamard transform), one row whatever the number of documents; the inverse transform, exact in
integers, gives the number of documents of each mask.  All 120 orders are evaluated on these 32 cells, and the Shapley sum of
a filter is in closed form: a document that fails f filters is removed by each of them in 120 / f of the orders.

Defined cases: a null text is empty; a null lang is the part of the empty string; a document of null doc_id has no label and
no smaller doc_id; rows of one doc_id and text are no copies of each other; a doc_id with several label rows is good
(toxic) if one of them says so; an empty table has no parts and so no rows; further columns are not looked at.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.plans.staging import staged

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def steps() -> list[dict]:
    """The fixed 600 steps of all orders: the filters seen before as a mask, and the step's own filter."""
    return [{"filter_order": "".join(p), "step": k + 1, "seen": sum(map(_bit, p[:k])), "own": _bit(x)} for p in permutations(FILTERS) for k, x in enumerate(p)]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each document: bit k of the mask is set if it fails filter k."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length(F.regexp_replace("body", "[^A-Z]+", ""))
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT_PERCENT * n, "C": 100 * upper > UPPER_PERCENT * F.length("body"), "D": F.col("body").rlike(SYMBOLS)}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("body")).withColumn("words", words)
    mask = sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))
    own = staged(own.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest")), "masks")
    # whoever isn't the smallest of its text is a copy: (doc_id, digest) is spread evenly however many copies there are
    firsts = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(firsts, ["doc_id", "digest"], "left").join(says, "doc_id", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, _bit("E")).otherwise(0)).alias("mask"), zero("good"), zero("toxic"))


def _sign(mask: Column | str, with_: Column | int) -> Column:
    """1 if both masks share an even number of filters, else -1."""
    both = F.col(mask) if isinstance(mask, str) else mask
    return 1 - 2 * (F.bit_count(both.bitwiseAND(with_)) % 2)


def cells(masked: DataFrame) -> DataFrame:
    """(part, n, good, toxic): of each part the documents with each mask, as arrays by mask."""
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(_sign("mask", s)).alias(f"w{s}") for s in range(CELLS)])
    waves = F.array(*[F.col(f"w{s}") for s in range(CELLS)])
    place = F.sequence(F.lit(0), F.lit(CELLS - 1))
    back = F.transform(place, lambda m: F.aggregate(F.zip_with(F.col("w"), place, lambda w, s: w * (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2))), F.lit(0).cast("long"), lambda a, x: a + x))
    # exact: the transform of the transform is CELLS times the counts
    counts = sums.select("part", "good", "toxic", waves.alias("w")).select("part", "good", "toxic", F.transform(back, lambda x: F.call_function("div", x, F.lit(CELLS).cast("long"))).alias("c"))
    each = counts.select("part", "good", "toxic", F.posexplode("c").alias("m", "c"))
    total = lambda when: F.sum(F.when(when, F.col("c")).otherwise(0))
    each = each.groupBy("part", "m").agg(F.sum("c").alias("n"), total(F.col("good") == 1).alias("good"), total(F.col("toxic") == 1).alias("toxic"))
    whole = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("m", "n", "good", "toxic"))).alias("x"))  # CELLS a part
    return whole.select("part", "x.n", "x.good", "x.toxic")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, seen: int, own: int>>")
    rows = cells(masks(docs, labels)).select("part", "n", "good", "toxic", F.inline(orders))
    place = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def over(counts: str, test, weight=lambda m: F.lit(1)) -> Column:
        terms = F.zip_with(counts, place, lambda c, m: F.when(test(m), c * weight(m)).otherwise(0))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    own, seen = F.col("own"), F.col("seen")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(seen) != 0
    here = lambda m: fails(m) & ~gone(m)
    orders_first = lambda m: F.call_function("div", F.lit(120), F.greatest(F.bit_count(m), F.lit(1)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("n", lambda m: m == own).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        over("n", fails, orders_first).alias("shapley"),
    )
