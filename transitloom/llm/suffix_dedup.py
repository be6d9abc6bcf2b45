"""Suffix-array dedup (operator 7): every byte covered by a string of `LENGTH` bytes that also starts earlier goes.

Strings are windows of `LENGTH` UTF-8 bytes within one document; a window is removed if an equal one starts in a smaller
doc_id, or earlier in the same document, of the input.

Each window is filed under its anchor, the smallest hash among its `GRAM`-byte strings, leftmost first; equal windows
have equal anchors at equal places.  Neighbouring windows with one anchor form a context, and only contexts are
shuffled.  Of equal contexts all but the first are removed; a task does this for its own documents before it sends
anything, so that a hot anchor costs a row for each task.  Where an anchor has different contexts, the first of each is
fetched with its bytes, and a sparse suffix array at the anchors tells which windows agree: the suffixes that begin at
the anchors, and the reversed prefixes that end there, are sorted by deep-shallow sorting, that is multikey quicksort to
`SHALLOW` bytes and then a blind trie for each group that still agrees.  Neighbours' common prefixes cut both orders
into classes; windows agree if their left and right classes do.  Anchors with more than `GROUP` contexts are dealt to
several tasks, and the windows each task keeps are compared once more by a 128-bit hash.

Contexts count as equal where their anchors' 64-bit hashes and their own do; windows of different contexts are compared
byte by byte.

Null texts are empty; texts shorter than `LENGTH` bytes keep all; a null doc_id matches nothing.  A doc_id identifies a
document: rows that repeat it with its text get the same result each.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._bitmap import Bitmap
from transitloom.llm._text import _BYTE, Sums, Text, chunks, mix, signed
from transitloom.plans.staging import discard, staged

LENGTH, GRAM, GROUP = 100, 32, 4096
#: Bytes that multikey quicksort looks at: the 8 of the anchor's name, the GRAM of the anchor, and 24 that differ.
SHALLOW = 8 + GRAM + 24
SEGMENT = 1 << 20
#: Bits of a place within a chunk; the same for all chunks, so that equal windows have equal anchors everywhere.
PLACE_BITS = 22
#: Contexts that a task compares among themselves before it sends them.
LOCAL_ROWS = 1_000_000
ROWS = "anchor long, class long, doc_id long, place long"
FOUND = "kind byte, anchor long, doc_id long, start long, skip long, n long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- sorting -----------------------------------------------------------------------------------------------------


class BlindTrie:
    """A trie whose nodes keep only the place where their strings differ; leaves keep the indices of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly to some leaf
            at, branches = node
            node = branches.get(s[at] if at < len(s) else -1) or next(iter(branches.values()))
        t = self.strings[node[0]]
        same = common(s, t)
        if same == len(s) == len(t):
            node.append(i)
            return
        key = s[same] if same < len(s) else -1
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        if isinstance(node, tuple) and node[0] == same:
            node[1][key] = [i]
            return
        split = (same, {(t[same] if same < len(t) else -1): node, key: [i]})
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def common(s: bytes, t: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(s), len(t))
    if s[:n] == t[:n]:
        return n
    differ = int.from_bytes(s[:n], "big") ^ int.from_bytes(t[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _multikey(order: np.ndarray, symbols: np.ndarray, small: int = 64) -> list[np.ndarray]:
    """Multikey quicksort of the rows of `symbols` (n x depth): groups of equal rows, in order.  Groups of at most `small`
    rows are sorted at once."""
    out, stack = [], [(order, 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == symbols.shape[1] or len(rows) <= 1:
            if len(rows):
                out.append(rows)
            continue
        if len(rows) <= small:
            rest = symbols[rows, depth:]
            by = np.lexsort(rest.T[::-1])
            rest = rest[by]
            out += np.split(rows[by], np.flatnonzero((rest[1:] != rest[:-1]).any(axis=1)) + 1)
            continue
        s = symbols[rows, depth]
        sample = np.sort(s[:: max(1, len(s) // 9)])
        pivot = sample[len(sample) // 2]
        stack += [(rows[s > pivot], depth), (rows[s == pivot], depth + 1), (rows[s < pivot], depth)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of `strings`, and the common prefix of each with the one before it (0 for the first)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-shallow // 8)
    head = np.frombuffer(b"".join(s[:shallow].ljust(8 * width, b"\0") for s in strings), dtype=">u8").reshape(n, width).astype(np.uint64)
    order: list[int] = []
    for group in _multikey(np.arange(n), head):
        if len(group) == 1:
            order.append(int(group[0]))
            continue
        trie = BlindTrie(strings)
        for i in group.tolist():
            trie.insert(i)
        order += trie.order()
    lcp = [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    return np.array(order), np.array(lcp)


# --- contexts ----------------------------------------------------------------------------------------------------


def _segments(part: pa.RecordBatch, segment: int = SEGMENT):
    """Texts of a chunk with doc_ids and offsets; a long document comes in pieces that overlap by LENGTH - 1 bytes."""
    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
    if part.num_rows > 1 or len(part.column("text")[0].as_buffer() or b"") <= segment:
        yield Text(part.column("text")), ids, np.zeros(part.num_rows, np.int64)
        return
    data = part.column("text")[0].as_buffer().to_pybytes()
    for a in range(0, len(data), segment):
        yield Text(pa.array([data[a : a + segment + LENGTH - 1]], pa.binary())), ids, np.array([a])


def contexts(text: Text) -> tuple[np.ndarray, ...]:
    """anchor hash, class hash, document number, start of the first window, bytes from there to the anchor and number
    of windows of each context."""
    data, n = text.data, len(text.data)
    width = LENGTH - GRAM + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = Sums(_BYTE[data])
    grams = mix((sums.sums[GRAM:] - sums.sums[:-GRAM]) * sums.down[: n + 1 - GRAM])
    if n >> PLACE_BITS:
        raise ValueError("a chunk is longer than its places can tell")
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (mix(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)  # of each window start
    step = np.zeros(len(anchor) + 1, np.int8)
    long = text.end - text.start >= LENGTH
    step[text.start[long]] += 1
    step[text.end[long] - LENGTH + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    change = np.empty(len(anchor), bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[1:] |= valid[1:] != valid[:-1]
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(anchor))
    used = valid[begin]
    begin, end = begin[used], end[used]
    at = anchor[begin]
    key = mix(grams[at])
    shape = ((at - begin).astype(np.uint64) << np.uint64(8)) + (end - begin).astype(np.uint64)
    kind = mix(sums.of(begin, end - 1 + LENGTH) + mix(shape) + key)
    return key, kind, np.searchsorted(text.start, begin, side="right") - 1, begin, at - begin, end - begin


def _place(start: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A start, the bytes from there to the anchor and a number of windows (0 marks a removed range) in one long."""
    return start << 16 | skip << 8 | n


def context_rows(docs: DataFrame, segment: int = SEGMENT, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Contexts (anchor, class, doc_id, place) and, with 0 windows, ranges removed within a task (class: length)."""

    def run(batches):
        held, size = [], 0

        def flush():
            anchor, kind, doc, start, skip, n = (np.concatenate([x[i] for x in held]) for i in range(6))
            order = np.lexsort((start, doc, kind))
            first, gone = _first_and_later(kind[order], doc[order], start[order])
            first, gone = order[first], order[gone]
            yield pa.record_batch([pa.array(signed(anchor[first])), pa.array(signed(kind[first])), pa.array(doc[first]), pa.array(_place(start[first], skip[first], n[first]))], names=["anchor", "class", "doc_id", "place"])
            if len(gone):
                d, a, b = merged(doc[gone], start[gone], start[gone] + n[gone] - 1 + LENGTH)
                yield pa.record_batch([pa.array(signed(mix(d.view(np.uint64)))), pa.array(b - a), pa.array(d), pa.array(_place(a, 0, 0))], names=["anchor", "class", "doc_id", "place"])

        for batch in batches:
            for part in chunks(batch, "text", segment):
                for text, ids, base in _segments(part, segment):
                    anchor, kind, doc, start, skip, n = contexts(text)
                    if len(anchor):
                        held.append((anchor, kind, ids[doc], start - text.start[doc] + base[doc], skip, n))
                        size += len(anchor)
            if size >= local_rows:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def _first_and_later(kind: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by class, document and start: the first of each class, and those that begin elsewhere."""
    new = np.append(True, kind[1:] != kind[:-1])
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.flatnonzero(new), np.flatnonzero((doc != doc[leader]) | (start != start[leader]))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, overlapping or touching ones united."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    # the furthest end so far within the document: documents are numbered so that a plain running maximum does it
    number = np.cumsum(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    far = np.maximum.accumulate(end + number * (1 << 40)) - number * (1 << 40)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(far, at) if len(at) else end


def _whole_groups(batches, columns: list[str], key: str):
    """Numpy columns of sorted batches, cut so that no group of equal `key` is divided."""
    held: dict[str, list] | None = None

    def joined():
        return {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns}

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        if held and k[0].as_py() != held[-1].column(key)[-1].as_py():
            yield joined()
            held = []
        values = k.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield joined()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined()


def compared(rows: DataFrame) -> DataFrame:
    """Removed ranges (kind 0: start, n bytes) and contexts to be compared in full (kind 1: start, n windows)."""

    def run(batches):
        for g in _whole_groups(batches, ["anchor", "class", "doc_id", "place"], "anchor"):
            anchor, kind, doc, place = g["anchor"], g["class"], g["doc_id"], g["place"]
            done = np.flatnonzero(place & 255 == 0)
            picks = [(0, done, kind)]
            live = np.flatnonzero(place & 255)
            if len(live):
                first, gone = _first_and_later(mix(kind[live].view(np.uint64)) + anchor[live].view(np.uint64), doc[live], place[live] >> 16)
                number = np.cumsum(np.append(True, anchor[live][1:] != anchor[live][:-1])) - 1
                several = np.bincount(number[first])[number[first]] > 1
                picks += [(0, live[gone], (place & 255) - 1 + LENGTH), (1, live[first[several]], place & 255)]
            for code, pick, length in picks:
                if len(pick):
                    yield pa.record_batch([pa.array(np.full(len(pick), code, np.int8)), pa.array(anchor[pick]), pa.array(doc[pick]), pa.array(place[pick] >> 16), pa.array(place[pick] >> 8 & 255), pa.array(length[pick])], names=["kind", "anchor", "doc_id", "start", "skip", "n"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "class", "doc_id", "place").mapInArrow(run, FOUND)


# --- comparing the contexts of an anchor --------------------------------------------------------------------------


def agreeing(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes], at: np.ndarray):
    """(context, window) of the windows that equal an earlier one of the same anchor, and of all others.

    texts[c] holds the bytes of context c from its first window on; its anchor is `at[c]` bytes further.
    """
    names = [a.tobytes() for a in anchor.astype(">u8")]
    right, r_lcp = deep_shallow([k + t[p:] for k, t, p in zip(names, texts, at.tolist(), strict=True)])
    left, l_lcp = deep_shallow([k + t[:p][::-1] for k, t, p in zip(names, texts, at.tolist(), strict=True)])
    m = len(texts)
    gone_c, gone_w, kept_c, kept_w = [], [], [], []
    age = np.empty(m, np.int64)
    age[np.lexsort((start + at, doc))] = np.arange(m)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for before in range(LENGTH - GRAM + 1):  # bytes of the window before the anchor
        has = np.flatnonzero((at - before >= 0) & (at - before < n))
        if not len(has):
            continue
        right_class[right] = np.cumsum(r_lcp < 8 + LENGTH - before)
        left_class[left] = np.cumsum(l_lcp < 8 + before)
        by = has[np.lexsort((age[has], left_class[has], right_class[has]))]
        same = np.append(False, (right_class[by][1:] == right_class[by][:-1]) & (left_class[by][1:] == left_class[by][:-1]))
        gone_c.append(by[same])
        gone_w.append(at[by[same]] - before)
        kept_c.append(by[~same])
        kept_w.append(at[by[~same]] - before)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gone_c, gone_w, kept_c, kept_w))


def with_bytes(docs: DataFrame, looked: DataFrame, group: int) -> DataFrame:
    """The contexts of `looked` with their bytes, dealt by anchor and, for large anchors, by document."""
    large = looked.groupBy("anchor").count().where(F.col("count") > group).select("anchor", F.ceil(F.col("count") / group).cast("long").alias("deals"))
    dealt = looked.join(large, "anchor", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc_id"), "deals") + 1, F.lit(0)))
    by_doc = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "deal", "start", "skip", "n")).alias("c"))
    some = docs.where(Bitmap(by_doc).has()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("c").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                out += [(x["anchor"], x["deal"], doc, x["start"], x["skip"], x["n"], data[x["start"] : x["start"] + x["n"] - 1 + LENGTH]) for x in own]
            for i in range(0, len(out), 20_000):
                cols = list(zip(*out[i : i + 20_000], strict=True))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 6 + [pa.binary()], strict=True)], names=["anchor", "deal", "doc_id", "start", "skip", "n", "content"])

    return some.join(by_doc, "doc_id").mapInArrow(run, "anchor long, deal long, doc_id long, start long, skip long, n long, content binary")


def window_matches(dealt: DataFrame) -> DataFrame:
    """Removed ranges (kind 0) and, for anchors that several tasks share, kept windows (kind 2) with h1 and h2."""
    columns = ["bucket", "anchor", "deal", "doc_id", "start", "skip", "n"]

    def run(batches):
        for g in _whole_groups(batches, [*columns, "content"], "bucket"):
            anchor, deal, doc, start, skip, n = (g[c] for c in columns[1:])
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (deal[1:] != deal[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
            anchor, deal, doc, start, skip, n = (x[new] for x in (anchor, deal, doc, start, skip, n))
            texts = g["content"][new].tolist()
            gone_c, gone_w, kept_c, kept_w = agreeing(mix(anchor.view(np.uint64)) + deal.view(np.uint64), doc, start, n, texts, skip)
            if len(gone_c):
                d, a, b = merged(doc[gone_c], start[gone_c] + gone_w, start[gone_c] + gone_w + LENGTH)
                none = pa.array(np.zeros(len(d), np.int64))
                yield pa.record_batch([pa.array(np.zeros(len(d), np.int8)), pa.array(d), pa.array(a), pa.array(b - a), none, none], names=["kind", "doc_id", "start", "n", "h1", "h2"])
            shared = deal[kept_c] > 0
            if shared.any():
                c, w = kept_c[shared], kept_w[shared]
                digests = [hashlib.blake2b(texts[i][j : j + LENGTH], digest_size=16).digest() for i, j in zip(c.tolist(), w.tolist(), strict=True)]
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(np.full(len(c), 2, np.int8)), pa.array(doc[c]), pa.array(start[c] + w), pa.array(np.full(len(c), LENGTH)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=["kind", "doc_id", "start", "n", "h1", "h2"])

    by = dealt.withColumn("bucket", F.xxhash64("anchor", "deal"))
    return by.repartition("bucket").sortWithinPartitions(*columns[:5]).select(*columns, "content").mapInArrow(run, "kind byte, doc_id long, start long, n long, h1 long, h2 long")


# --- results -----------------------------------------------------------------------------------------------------


def removed_ranges(docs: DataFrame, group: int = GROUP, **sizes) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, start, n): ranges of removed bytes, which may overlap; and the staged tables that it reads."""
    found = staged(compared(context_rows(docs, **sizes)), "found")
    matches = staged(window_matches(with_bytes(docs, found.where("kind = 1"), group)), "matches")
    rows = matches.where("kind = 2")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = rows.join(first, ["h1", "h2"]).where(F.struct("doc_id", "start") != F.col("first"))
    columns = ["doc_id", "start", "n"]
    return found.where("kind = 0").select(*columns).unionByName(matches.where("kind = 0").select(*columns)).unionByName(later.select(*columns)), [found, matches]


def _with_ranges(docs: DataFrame, group: int, **sizes) -> DataFrame:
    """`docs` (doc_id, text first) with `gone`, an array of removed ranges, or null."""
    ranges, read = removed_ranges(docs, group, **sizes)
    gone = staged(ranges.groupBy(F.col("doc_id").alias("_gone_doc")).agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    discard(*read)
    touched = Bitmap(gone.select("_gone_doc"), "_gone_doc")
    some = docs.where(touched.has()).join(gone, F.col("doc_id").cast("long") == F.col("_gone_doc"), "left").drop("_gone_doc")
    return docs.where(~touched.has()).withColumn("gone", F.lit(None).cast("array<struct<start:long,n:long>>")).unionByName(some)


def _kept(data: bytes, gone: list | None) -> tuple[bytes, int, int]:
    """What is left, and the number of removed bytes and of maximal removed runs."""
    if not gone:
        return data, 0, 0
    start = np.array([x["start"] for x in gone], dtype=np.int64)
    n = np.array([x["n"] for x in gone], dtype=np.int64)
    _, a, b = merged(np.zeros(len(start), np.int64), start, start + n)
    keep, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        keep.append(data[at:x])
        at = y
    keep.append(data[at:])
    return b"".join(keep), int((b - a).sum()), len(a)


def report(docs: DataFrame, group: int = GROUP, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `docs`; `sizes` are those of `context_rows`."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = (text or "").encode()
                keep, n, spans = _kept(data, gone)
                out.append((doc, len(data), n, spans, hashlib.sha256(keep).hexdigest()))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), group, **sizes).mapInArrow(run, RESULT)


def dedup(docs: DataFrame, group: int = GROUP, **sizes) -> DataFrame:
    """doc_id and the text that is left of each row of `docs`; characters that a cut divides are replaced."""

    def run(batches):
        for batch in batches:
            texts = [t if t is None else _kept(t.encode(), g)[0].decode("utf-8", "replace") for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), group, **sizes).mapInArrow(run, "doc_id long, text string")
