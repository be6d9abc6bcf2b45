"""Quality rules (operator 5): base counts and a hashed n-gram log-likelihood ratio.

Words are `[^\\x20\\x09-\\x0D]+`.  Base counts: code points in words, symbols `[#*$%&|<>]`, repeated lines, and words in
8-word windows that occur twice or more in the text.  A document fails the base rules with fewer than `LEAST_WORDS`
words or when repeated words make up more than 30 %.

The method: lower-cased word unigrams and bigrams are hashed into `buckets` counters.  The raw multinomial counts all
documents; the target multinomial counts trusted ones, a sample of at most about `train_documents` labelled rows with
quality 1.  A document's verdict is its mean log-likelihood ratio a feature, kept if it reaches `threshold`: a fixed
number, so the verdict of a document doesn't depend on how others are ordered.  Both tables have a bounded size and
are broadcast.

Null texts have no words and fail; a doc_id that is null has no label; labels that are null don't count; without any
trusted document the ratio is 0 and the base rules decide.  Repeated rows are judged each by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._text import LOWER, NOT_SPACE, Text, byte_sums, chunks, runs

LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
BUCKETS = 1 << 14
TRAIN_DOCUMENTS = 20_000
THRESHOLD = -0.1
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def features(words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a chunk, and the number of each document's word they begin at."""
    at, pairs = words.grams(2)
    where = np.concatenate([np.arange(len(words.start)), at])
    return (np.concatenate([words.hash, pairs]) % np.uint64(buckets)).astype(np.int64), where


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def _later_equal(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flags those that equal an earlier one of the same document."""
    order = np.lexsort((np.arange(len(hashes)), hashes, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    return out


def base_counts(text: Text, words) -> dict[str, np.ndarray]:
    data = text.data
    bounds = np.append(text.start, len(data))
    inside = NOT_SPACE[data]
    chars = _sum_by(inside & ((data & 0xC0) != 0x80), bounds)
    symbols = _sum_by(SYMBOLS[data], bounds)
    # lines: the separator after each document is a line feed, so every line ends with one
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    if len(ends):
        has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begins)
        begins, ends = begins[has_word], ends[has_word]
    line_doc = np.searchsorted(text.start, begins, side="right") - 1
    again = _later_equal(line_doc, byte_sums(data).of(begins, ends))
    dup_lines = np.bincount(line_doc[again], minlength=text.n)
    at, grams = words.grams(WINDOW)
    doc = words.doc()
    order = np.lexsort((grams, doc[at]))
    g, d = grams[order], doc[at][order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = runs(at[order][twice], WINDOW, len(words.start))
    return {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": _sum_by(covered, words.first)}


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, train_documents: int = TRAIN_DOCUMENTS) -> np.ndarray:
    """The log ratio of each bucket's target and raw frequency."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id")
    n = good.count()
    if n > train_documents:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < train_documents)
    # Drawn by hash, the sample may exceed its expected size slightly; the limit makes the bound of the broadcast hard.
    ids = np.unique(np.array([r[0] for r in good.limit(2 * train_documents).collect()], dtype=np.int64))
    trusted = spark.sparkContext.broadcast(ids)

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Text(part.column("text")).words(NOT_SPACE, LOWER)
                found, where = features(words, buckets)
                raw += np.bincount(found, minlength=buckets)
                doc = part.column("doc_id")
                chosen = np.isin(doc.fill_null(-1).to_numpy(zero_copy_only=False), trusted.value) & ~np.asarray(doc.is_null())
                if chosen.any():
                    target += np.bincount(found[np.repeat(chosen, words.counts)[where]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def judged(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, kept and llr (mean log-likelihood ratio a feature) of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                text = Text(part.column("text"))
                words = text.words(NOT_SPACE)
                base = base_counts(text, words)
                folded = text.words(NOT_SPACE, LOWER)
                found, where = features(folded, len(shared.value))
                per_word = np.bincount(where, weights=shared.value[found], minlength=len(words.start)) if len(where) else np.zeros(0)
                n = words.counts
                llr = _sum_by(per_word, words.first) / np.maximum(1, 2 * n - 1)
                failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEATED_PERCENT * n)
                out = {"doc_id": part.column("doc_id"), "n_words": n, **base, "base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}
                yield pa.record_batch([x if k == "doc_id" else pa.array(x) for k, x in out.items()], names=list(out))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
