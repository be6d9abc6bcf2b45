"""A bitmap of document ids that fits one row, for keeping most documents out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.plans.staging import staged

BITMAP_BITS = 1 << 22


class Bitmap:
    """A set of doc_ids as one array of longs; `has` may hold for others too."""

    def __init__(self, ids: DataFrame, column: str = "doc_id", bits: int = BITMAP_BITS):
        at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
        self.bits = bits
        spark = ids.sparkSession
        rows = ids.select((at / 64).cast("long").alias("w"), F.lit(1).cast("long").alias("one"), (at % 64).cast("int").alias("s"))
        rows = rows.selectExpr("w", "shiftleft(one, s) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
        dense = spark.range(bits // 64).withColumnRenamed("id", "w").join(rows, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
        # One row of bits / 8 bytes, whatever the input.
        self.words = staged(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")), "bitmap")

    def has(self, doc_id: str = "doc_id") -> Column:
        return self.has_value(F.col(doc_id).cast("long"))

    def has_value(self, value: Column) -> Column:
        """Whether the set may hold a long; false for null."""
        at = F.pmod(F.xxhash64(value), F.lit(self.bits))
        word = F.element_at(self.words.select("words").scalar(), (at / 64).cast("int") + 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(value), F.lit(64)).cast("int"))
        return F.coalesce(value.isNotNull() & (word.bitwiseAND(bit) != 0), F.lit(False))
