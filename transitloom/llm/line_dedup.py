"""Line dedup (operator 8): an exact set-similarity join of lines, DataFrame functions only.

A line is the set of its distinct space-separated words; a position is (doc_id, line number).  A line is removed if an
earlier line of any document, as given in the input, has a Jaccard similarity of 4/5 or more with it.

Words become 64-bit hashes whose first bits are replaced by the rarity rank of their bucket, over counts of all words
of the corpus, so that sorting a set puts rare words first; the replacement is one to one.  Equal sets are found by
their hashes and size and keep their first position; only that one is compared with other sets.

Two neighbours in a sorted set are a link.  Of sets of x and y words with o in common, a word that is missing from the
other set breaks two of its links and one of the other's, so 2 (x - o) + (y - o) links of x at most are not links of y.
A similarity of 4/5 needs 9 o >= 4 (x + y) and 5 y >= 4 x, which makes these 2 x / 5 at most.  All sets of four words or
more have two links more than that, so two similar sets share two of the first 2 n / 5 + 2 links of each (prefix
filter); sizes must be within 4/5 (length filter), and parity sketches, which never differ more than the sets do, must be
close.  Links are far rarer than words, so that most belong to one set only
and end there.  Each set is first compared with the earliest set that shares a link, which settles members of
large groups with few comparisons; only sets that stay unmatched are compared with all their other candidates.
Similarities are verified on the words of the lines.

Where only some lines or documents are needed, a bitmap of fixed size keeps most others out of the shuffle; a full
bitmap costs time but loses nothing.

Null texts have no lines and stay as they are, as do rows with a null doc_id, which match nothing.  Lines without words
stay.  Rows of the same doc_id are one document with the same positions, and do not remove each other's lines at equal
positions.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.llm._bitmap import Bitmap
from transitloom.llm._names import free_names
from transitloom.plans.staging import discard, staged

#: Words are counted in 2**BUCKET_BITS counters, by the first bits of their hashes.
BUCKET_BITS = 16


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def word_ranks(docs: DataFrame) -> str:
    """For each bucket the number that turns it into its rank by xor, comma-joined.  Ranks go by the bucket's count in the
    corpus, rarest first, and each bucket has a rank of its own, so words' keys are as distinct as their hashes."""
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    rows = words.select(_bucket(F.xxhash64("w")).alias("b")).groupBy("b").count().toArrow()  # one row a bucket
    size = 1 << BUCKET_BITS
    counts = np.zeros(size, dtype=np.int64)
    counts[rows.column("b").to_numpy()] = rows.column("count").to_numpy()
    masks = np.arange(size)
    masks[np.argsort(counts, kind="stable")] ^= np.arange(size) ^ (size >> 1)
    return ",".join(map(str, masks.tolist()))


def sorted_words(line: Column, ranks: str) -> Column:
    """The line's distinct words as longs, rarest first."""
    table = F.split(F.lit(ranks), ",").cast("array<int>")  # a constant, folded before the plan runs

    def key(w: Column) -> Column:
        h = F.xxhash64(w)
        # Never null: arrays of plain longs are sorted without objects.
        return h.bitwiseXOR(F.shiftleft(F.coalesce(F.get(table, _bucket(h)), F.lit(0)).cast("long"), 64 - BUCKET_BITS))

    return F.sort_array(F.array_remove(F.array_distinct(F.transform(F.split(line, " "), key)), key(F.lit(""))))


def _parities(keys: Column) -> Column:
    """A long with the parities of the numbers of keys in 64 classes, by their last six bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))


def lines(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, line, n (words), sid and sid2 (hashes of the set), sketch (parities of all words) and prefix (first halves of
    the words in whose links a match must share two) of every line."""
    every = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("trim(t) <> ''")
    keyed = every.select("doc_id", "line", sorted_words(F.col("t"), ranks).alias("keys"))
    # Below four words only equal sets are similar enough.
    words = F.when(F.size("keys") >= 4, F.slice("keys", F.lit(1), F.floor(F.size("keys") * 2 / 5).cast("int") + 3)).otherwise(F.array().cast("array<long>"))
    prefix = F.transform(words, lambda k: F.shiftright(k, 32).cast("int"))
    return keyed.select("doc_id", "line", F.size("keys").alias("n"), F.xxhash64("keys").alias("sid"), F.hash("keys").alias("sid2"), _parities(F.col("keys")).alias("sketch"), prefix.alias("prefix"))


def first_of_equals(all_lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines at the first position of each set, (doc_id, line) of the others, and the staged table that both read
    besides `all_lines`.

    Sets count as equal where their hashes and sizes are.  Only lines that a bitmap does not rule out are
    shuffled; sets that make up a thousandth of all lines or more, so at most a thousand, are broadcast instead.
    """
    key = ["sid", "sid2", "n"]
    at = F.struct("doc_id", "line")
    again = all_lines.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("c"))
    again = staged(again.where("first <> last").drop("last"), "again")
    share = -(-all_lines.count() // 1000)
    hot, cold = F.broadcast(again.where(F.col("c") >= share).drop("c")), again.where(F.col("c") < share).drop("c")
    repeated = Bitmap(again.select("sid"), "sid")
    some = all_lines.where(repeated.has("sid"))
    marked = staged(some.join(hot, key).unionByName(some.join(hot, key, "left_anti").join(cold, key, "left"), allowMissingColumns=True), "marked")
    copy = F.col("first").isNotNull() & (F.col("first") != at)
    firsts = all_lines.where(~repeated.has("sid")).unionByName(marked.where(~copy).drop("first")).drop("sid", "sid2")
    discard(again)
    return firsts, marked.where(copy).select("doc_id", "line"), marked


_PAIR = ["y_doc", "y_line", "x_doc", "x_line"]


def shared_links(first_lines: DataFrame) -> DataFrame:
    """link, doc, line, n and sketch of each prefix link of more than one set, and those of the earliest set of the link."""
    from pyspark.sql import Window

    each = first_lines.select("doc_id", "line", "n", "sketch", "prefix", F.posexplode("prefix").alias("i", "a")).where("i + 1 < size(prefix)")
    entries = each.selectExpr(f"shiftleft(cast(a as long), 32) | (prefix[i + 1] & {(1 << 32) - 1}) as link", "doc_id as doc", "shiftleft(cast(line as long), 32) | n as at", "sketch")
    same = Window.partitionBy("link")
    # Two windows of one sort: the second meets only what the first leaves.
    found = entries.withColumn("c", F.count("*").over(same)).where("c > 1").withColumn("lead", F.min(F.struct("doc", "at", "sketch")).over(same))
    number = lambda c: [f"cast(shiftright({c}, 32) as int)", f"cast({c} & {(1 << 32) - 1} as int)"]
    names = ["line", "n", "lead_line", "lead_n"]
    return found.selectExpr("link", "doc", "sketch", "lead.doc as lead_doc", "lead.sketch as lead_sketch", *[f"{e} as {c}" for c, e in zip(names, number("at") + number("lead.at"), strict=True)])


def _sharing_two(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_PAIR).count().where("count > 1").drop("count")


def led_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (y, x) of positions of sets that may be similar, where x is the earliest set of links they share."""
    return _sharing_two(shared.where("(lead_doc < doc or lead_doc = doc and lead_line < line) and 5 * n >= 4 * lead_n and 5 * lead_n >= 4 * n and 9 * bit_count(sketch ^ lead_sketch) <= n + lead_n").selectExpr("doc as y_doc", "line as y_line", "lead_doc as x_doc", "lead_line as x_line"))


def other_pairs(shared: DataFrame, matched: DataFrame) -> DataFrame:
    """All pairs (y, x) of positions of sets that may be similar, x earlier, of the y that are not in `matched`."""
    side = lambda t, s: t.select("link", *[F.col(c).alias(f"{s}_{c}") for c in ("doc", "line", "n", "sketch")])
    known = matched.select(F.col("doc_id").alias("doc"), "line")
    y = side(shared.join(known, ["doc", "line"], "left_anti"), "y")
    return _sharing_two(y.join(side(shared, "x"), "link").where("(x_doc < y_doc or x_doc = y_doc and x_line < y_line) and 5 * x_n >= 4 * y_n and 5 * y_n >= 4 * x_n and 9 * bit_count(x_sketch ^ y_sketch) <= x_n + y_n"))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line) of the y in pairs (y, x) that are similar, compared on their words."""
    place = F.xxhash64("doc_id", "line")
    need = staged(pairs.selectExpr("y_doc as doc_id", "y_line as line").unionByName(pairs.selectExpr("x_doc as doc_id", "x_line as line")).distinct().withColumn("place", place), "need")
    every = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    some = every.where(Bitmap(need, "place").has_value(place)).join(need.drop("place"), ["doc_id", "line"], "left_semi")
    texts = staged(some, "texts")
    side = lambda s: texts.selectExpr(f"doc_id as {s}_doc", f"line as {s}_line", f"t as {s}_t")
    words = lambda c: F.array_remove(F.array_distinct(F.split(c, " ")), "")
    both = pairs.join(side("y"), ["y_doc", "y_line"]).join(side("x"), ["x_doc", "x_line"]).select("y_doc", "y_line", words("x_t").alias("x"), words("y_t").alias("y"))
    similar = both.withColumn("common", F.size(F.array_intersect("x", "y"))).where("9 * common >= 4 * (size(x) + size(y))")
    found = staged(similar.select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line")).distinct(), "matched")
    discard(need, texts)
    return found


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of every line that is removed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_lines = staged(lines(docs, word_ranks(docs)), "lines")
    firsts, copies, marked = first_of_equals(all_lines)
    shared = staged(shared_links(firsts), "shared")
    copies = staged(copies, "copies")
    discard(all_lines, marked)
    led = staged(led_pairs(shared), "pairs")
    matched = verified(docs, led)
    rest = staged(other_pairs(shared, matched).join(led, _PAIR, "left_anti"), "pairs")
    discard(shared, led)
    second = verified(docs, rest)
    removed = staged(copies.unionByName(matched).unionByName(second).distinct(), "removed")
    discard(copies, rest, matched, second)
    return removed


def _cut(docs: DataFrame, removed: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with the lines of `removed` cut from their texts (null where all are gone) and a column with the number of
    lines cut, and that column's name."""
    doc, gone_lines, left, number = free_names(docs.columns, "doc", "gone", "left", "number")
    gone = removed.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(gone_lines))
    touched = Bitmap(gone, doc)
    kept = F.filter(F.split("text", "\n"), lambda t, i: ~F.array_contains(gone_lines, i))
    some = docs.where(touched.has()).join(gone, F.col("doc_id").cast("long") == F.col(doc), "left")
    some = some.withColumn(left, F.when(F.col(gone_lines).isNotNull() & F.col("text").isNotNull(), kept)).withColumn(number, F.coalesce(F.size(F.split("text", "\n")) - F.size(left), F.lit(0)).cast("long"))
    text = F.when(F.col(left).isNull(), F.col("text")).when(F.size(left) > 0, F.array_join(left, "\n"))
    whole = docs.where(~touched.has()).withColumn(number, F.lit(0).cast("long"))
    return whole.unionByName(some.withColumn("text", text).select(*docs.columns, number)), number


def dedup(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """`docs` with later matches cut from their texts.  Documents that lose all their lines become empty, or are
    dropped with `drop_emptied`."""
    cut, number = _cut(docs, later_matches(docs))
    if drop_emptied:
        cut = cut.where(F.col("text").isNotNull() | (F.col(number) == 0))
    return cut.withColumn("text", F.when(F.col(number) > 0, F.coalesce("text", F.lit(""))).otherwise(F.col("text"))).drop(number)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of each row of `docs`."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    cut, number = _cut(narrow, later_matches(narrow))
    return cut.select("doc_id", "n_lines", F.col(number).alias("n_removed"), F.when(F.col(number) > 0, F.coalesce("text", F.lit(""))).otherwise(F.col("text")).alias("text"))
