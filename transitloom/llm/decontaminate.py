"""Benchmark decontamination (operator 6): a broadcast hash set of the benchmark's normalised word n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  An item's windows are its runs of `width`
words, or all its words where it has fewer.  Each document is scanned once for windows by hash; a hit counts only if
its words equal those of the benchmark.  A document word inside any occurrence is hit.

The benchmark goes to the executors in blocks of at most `block_windows` windows, of which the driver holds two at a
time; longer items are cut between words into pieces that overlap, which keeps their windows.  One block, the usual
case, needs no shuffle.  For more blocks, the documents are scanned once for each, and the hits of equal texts are united;
results are the same.  Whether a row goes depends on its text alone, so equal texts go or stay together.

Nulls have no words.  Items without words match nothing, as do null items; equal windows of several items count for
each of them.  Rows of equal doc_id are reported each by themselves.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._bitmap import Bitmap
from transitloom.llm._names import free_names
from transitloom.llm._text import ALNUM, LOWER, Text, chunks, runs
from transitloom.plans.staging import discard, staged

WIDTH = 13
BLOCK_WINDOWS = 2_000_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "key string, hits array<int>, items array<string>"
#: Tasks that rows of one contaminated text are dealt to.
DEALS = 16
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


class Windows:
    """The windows of some items, by their number of words: sorted hashes, and the words and items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        if items:
            text = Text(pa.array([t for _, t in items], pa.string()))
            words = text.words(ALNUM, LOWER)
            for n in range(1, width + 1):
                at, hashes = words.grams(n)
                for a, h in zip(at.tolist(), hashes.tolist(), strict=True):
                    i = int(np.searchsorted(words.first, a, side="right")) - 1
                    if n == width or words.first[i + 1] - words.first[i] == n:
                        found[n][h][words.strings(a, a + n)].add(items[i][0])
        self.by_hash = {n: {h: dict(x) for h, x in d.items()} for n, d in found.items()}
        self.sorted = {n: np.sort(np.array(list(d), dtype=np.uint64)) for n, d in self.by_hash.items()}

    def scan(self, words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """A mask of the hit words of a chunk, and the items found in each document."""
        hit, items = np.zeros(len(words.start), bool), defaultdict(set)
        for n, known in self.sorted.items():
            at, hashes = words.grams(n)
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            sure = []
            for k in np.flatnonzero(known[near] == hashes).tolist():
                a = int(at[k])
                if who := self.by_hash[n][int(hashes[k])].get(words.strings(a, a + n)):
                    sure.append(a)
                    items[int(np.searchsorted(words.first, a, side="right")) - 1] |= who
            if sure:
                hit |= runs(np.array(sure), n, len(hit))
        return hit, items


def _blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[Windows]:
    """The benchmark's windows in blocks; items arrive one partition at a time, never all at once."""
    items, size, some = [], 0, False
    for row in benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        pieces = [row[1]]
        if len(row[1]) // 2 + 1 > block_windows and len(words := WORD.findall(row[1])) >= width:
            step = max(1, block_windows)
            pieces = [" ".join(words[i : i + step + width - 1]) for i in range(0, len(words) - width + 1, step)]
        for piece in pieces:
            items.append((row[0], piece))
            size += len(piece) // 2 + 1  # at least as many as it has words
            if size >= block_windows:
                yield Windows(items, width)
                items, size, some = [], 0, True
    if items or not some:
        yield Windows(items, width)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int):
    """`docs`, and a function (part, words) -> hit mask of the words, item ids of each document.

    For several blocks, docs gets two more columns that carry the hits.
    """
    spark, blocks = docs.sparkSession, _blocks(benchmark, width, block_windows)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        shared = spark.sparkContext.broadcast(block)

        def by_scan(part, words):
            hit, items = shared.value.scan(words)
            return hit, [items.get(i, ()) for i in range(part.num_rows)]

        return docs, by_scan

    found = []
    keyed = docs.where("text is not null").select("text", F.sha2("text", 256).alias("key"))
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, "text"):
                    words = Text(part.column("text")).words(ALNUM, LOWER)
                    hit, items = shared.value.scan(words)
                    some = sorted(items)
                    where = [np.flatnonzero(hit[words.first[i] : words.first[i + 1]]).tolist() for i in some]
                    yield pa.record_batch([part.column("key").take(pa.array(some, pa.int64())), pa.array(where, pa.list_(pa.int32())), pa.array([sorted(items[i]) for i in some], pa.list_(pa.string()))], names=["key", "hits", "items"])

        found.append(staged(keyed.mapInArrow(run, SPANS).dropDuplicates(["key"]), "hits"))
        shared.destroy()
        block, following = following, next(blocks, None)
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    key, deal, hits, items = free_names(docs.columns, "key", "deal", "hits", "items")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    united = staged(all_found.groupBy(F.col("key").alias(key)).agg(flat("hits").alias(hits), flat("items").alias(items)), "united")
    discard(*found)
    number = F.xxhash64(key)
    touched = Bitmap(united.select(number.alias(key)), key)
    marked = docs.withColumn(key, F.sha2("text", 256)).withColumn(deal, F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)))
    some = F.coalesce(touched.has_value(number), F.lit(False))
    dealt = united.withColumn(deal, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    carried = marked.where(some).join(dealt, [key, deal], "left").select(*docs.columns, hits, items)
    plain = docs.where(~F.coalesce(touched.has_value(F.xxhash64(F.sha2("text", 256))), F.lit(False)))
    kinds = united.schema
    plain = plain.select(*docs.columns, F.lit(None).cast(kinds[hits].dataType).alias(hits), F.lit(None).cast(kinds[items].dataType).alias(items))

    def by_column(part, words):
        hit = np.zeros(len(words.start), bool)
        for i, at in enumerate(part.column(hits).to_pylist()):
            if at:
                hit[words.first[i] + np.array(at)] = True
        return hit, [x or () for x in part.column(items).to_pylist()]

    return plain.unionByName(carried), by_column


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (hits make up `percent` of the words or more)."""
    marked, hits_of = _hits(docs.select("doc_id", "text"), benchmark, width, block_windows)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Text(part.column("text")).words(ALNUM, LOWER)
                hit, found = hits_of(part, words)
                n, n_hit = words.counts, _per_doc(hit, words)
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array([digest(x) for x in found]), pa.array((n_hit > 0) & (100 * n_hit >= percent * n))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return marked.mapInArrow(run, RESULT)


def _per_doc(hit: np.ndarray, words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5, spans: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` without the rows whose texts are contaminated or, with `spans`, with hit words cut out of those texts; all
    columns stay."""
    marked, hits_of = _hits(docs, benchmark, width, block_windows)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                text = Text(part.column("text"))
                words = text.words(ALNUM, LOWER)
                hit, _ = hits_of(part, words)
                part = part.select(columns)
                n, n_hit = words.counts, _per_doc(hit, words)
                bad = (n_hit > 0) & (100 * n_hit >= percent * n)
                if not spans:
                    yield part.filter(pa.array(~bad))
                    continue
                texts = part.column("text").to_pylist()
                for i in np.flatnonzero(bad).tolist():
                    cut, a = hit[words.first[i] : words.first[i + 1]], int(words.first[i])
                    keep, at = bytearray(), int(text.start[i])
                    for k in np.flatnonzero(cut).tolist():
                        keep += text.data[at : words.start[a + k]].tobytes()
                        at = int(words.end[a + k])
                    texts[i] = (keep + text.data[at : text.end[i]].tobytes()).decode("utf-8", "replace")
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return marked.mapInArrow(run, docs.schema)
