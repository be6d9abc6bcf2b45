"""N-gram Jaccard join (operator 3) by PartEnum signatures.

A document is the set of its distinct `width`-word shingles (64-bit hashes).  Sizes fall into bands [l, l / similarity];
two similar sets lie in one band or in neighbouring ones, so each set takes part in the instances of its own band and
of the band below, and in an instance their symmetric difference is at most k.  The feature domain is split by hash
into n1 parts of n2 cells.  Two sets within k differ in at most one cell of more than `slack` parts, and so agree on one
of the subsets of n2 - 1 cells there: each such subset's content is a signature.  Subsets without any feature give no
signature; sets with more than `slack` parts that have one are also entered with other seeds, and at last with their
empty subsets, so that no pair is lost.

Equal sets are merged first.  Sets that share a signature form a bucket; equal buckets are merged.  Links within buckets
are found by rounds: each set is compared with one leader of a bucket that isn't yet known to be in its component,
which takes one comparison a set and round and joins large groups of near copies without all their pairs.  The first
leaders are the sets that lie in most buckets, the centres of such groups.  Of the buckets that still hold several
components all remaining pairs of different components are looked at: directly in buckets of up to SMALL members; larger
ones, which passages that many sets hold bring about, are split by their members' rarest shingles, of which a linked pair
shares one early enough in the order of rarity, and a pair found so must share a bucket as well.  An exact lower bound on the difference from parity sketches rejects most
pairs, and the rest are verified on the sets themselves.  Components come from `plans.components`.

Null and empty texts and texts without words have an empty set and are linked with nothing: their component is their
own doc_id.  Equal rows fall into one class; rows of one doc_id with different texts are separate sets.  A null doc_id
is ignored when the smallest is taken.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._bitmap import Bitmap
from transitloom.llm._names import free_names
from transitloom.llm._text import LOWER, NOT_SPACE, Text, chunks, mix, signed
from transitloom.plans.components import components
from transitloom.plans.staging import discard, staged

WIDTH, PERCENT = 4, 85
LEADER_ROUNDS = 1
#: Members of a bucket whose pairs are taken directly.
SMALL = 32
SEEDS = 3
RARITY_BITS = 18
#: Sets whose shingles a task counts.
TALLY_SETS = 50_000
#: Bits of the bitmap of sets that need verification (8 MB); a full bitmap only means that more sets are kept.
SET_BITS = 1 << 26
#: Equal sets that a task remembers in order to send their signatures once.
REMEMBERED = 1_000_000
ROWS = 200_000


class Bands:
    """Bands of sizes, and for each the largest difference k, n1, n2 and slack."""

    def __init__(self, percent: int):
        self.percent, self.low, self.params = percent, [1], []

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def instance(self, i: int) -> tuple[int, int, int, int]:
        while len(self.params) <= i:
            j = len(self.params)
            self.of(self.low[-1])
            most = self.low[j + 1] - 1
            p = self.percent
            k = (100 - p) * (most + 100 * most // p) // (100 + p)
            n2 = 3 if k < 8 else 2
            n1 = k // 2 + 1
            slack = n1 // 30 + (k >= 8)
            self.params.append((k, n1 + slack, n2, slack))
        return self.params[i]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    text = Text(texts)
    words = text.words(NOT_SPACE, LOWER)
    at, grams = words.grams(width)
    first = np.searchsorted(at, words.first)
    whole, counts = words.whole(), words.counts
    out = []
    for i in range(text.n):
        if counts[i] >= width:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        else:
            out.append(whole[i : i + 1] if counts[i] else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(mix(np.array([np.uint64(len(s)) + mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)]))[0])


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    own, out = bands.of(len(s)), []
    for i in (own, own - 1):
        if i < 0:
            continue
        k, n1, n2, slack = bands.instance(i)
        if k == 0:
            continue  # only equal sets, which are merged already
        for seed in range(SEEDS):
            h = mix(s + np.uint64((2 * i + 1) * 0x632BE59BD9B4E019 + seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            cell = ((h >> np.uint64(40)) % np.uint64(n1)).astype(np.int64) * n2 + ((h >> np.uint64(20)) % np.uint64(n2)).astype(np.int64)
            v = mix(h)
            size = np.bincount(cell, minlength=n1 * n2)
            low = np.bincount(cell, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n1 * n2).astype(np.uint64)
            high = np.bincount(cell, weights=(v >> np.uint64(32)).astype(np.float64), minlength=n1 * n2).astype(np.uint64)
            content = (low + mix(high)).reshape(n1, n2)
            size = size.reshape(n1, n2)
            subset = content.sum(axis=1, dtype=np.uint64, keepdims=True) - content  # all cells of a part but one
            filled = size.sum(axis=1, keepdims=True) - size > 0
            names = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) * np.uint64(SEEDS) + np.uint64(seed)
            sig = mix(mix(subset + np.uint64(i)) + names)
            empty_parts = int((~filled).any(axis=1).sum())
            last = empty_parts > slack and seed == SEEDS - 1
            out.append(sig.ravel() if last else sig[filled])
            if empty_parts <= slack:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch_words(n: int) -> int:
    """64-bit words of a parity sketch: about 8 bits for each element of the largest difference."""
    return 1 << max(0, math.ceil(math.log2(max(1, 1.4 * n / 64))))


def sketch(s: np.ndarray) -> np.ndarray:
    bits = 64 * sketch_words(len(s))
    odd = np.bincount((mix(s ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and sid (the set's hash; null for empty sets)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                sid = np.array([set_id(s) for s in sets], dtype=np.uint64)
                n = np.array([len(s) for s in sets])
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(signed(sid), mask=n == 0)], names=["doc_id", "n_shingles", "sid"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sid long")


def signed_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, sid) of every set; a task sends equal sets once."""

    def run(batches):
        bands, seen, sigs, sids, rows = Bands(percent), set(), [], [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                for s in shingle_sets(part.column("text"), width):
                    if len(s) and (sid := set_id(s)) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(sid)
                        sigs.append(x := signatures(s, bands))
                        sids.append(np.full(len(x), sid, dtype=np.uint64))
                        rows += len(x)
                if rows >= ROWS:
                    yield pa.record_batch([pa.array(signed(np.concatenate(sigs))), pa.array(signed(np.concatenate(sids)))], names=["sig", "sid"])
                    sigs, sids, rows = [], [], 0
        if rows:
            yield pa.record_batch([pa.array(signed(np.concatenate(sigs))), pa.array(signed(np.concatenate(sids)))], names=["sig", "sid"])

    return docs.select("text").mapInArrow(run, "sig long, sid long")


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, sid) of the signatures that several sets share; signatures with equal members count once."""
    from pyspark.sql import Window

    w = Window.partitionBy("sig")
    part = F.xxhash64("sid").bitwiseAND(F.lit((1 << 40) - 1))
    grouped = rows.select("sig", "sid", F.min("sid").over(w).alias("lo"), F.max("sid").over(w).alias("hi"), F.count("sid").over(w).alias("n"), F.sum(part).over(w).alias("s")).where("lo < hi")
    return grouped.select(F.xxhash64("lo", "hi", "n", "s").alias("bucket"), "sid").distinct()


def kept_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid, n, sketch and content of the sets in `wanted` (sid), and a few others: a bitmap decides."""
    bits = SET_BITS
    at = F.pmod(F.col("sid"), F.lit(bits))
    # The bitmap has a fixed size, so its words reach the driver in a bounded number of rows.
    rows = wanted.select((at / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(sid, {bits}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, seen = shared.value, set()
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for s in shingle_sets(part.column("text"), width):
                    if not len(s):
                        continue
                    sid = set_id(s)
                    at = sid % bits
                    if sid in seen or not int(table[at >> 6]) >> (at & 63) & 1:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    rows.append((sid - (sid >> 63 << 64), len(s), sketch(s).tolist(), s.astype("<u8").tobytes()))
                if rows:
                    sids, n, sketches, contents = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(sids, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(contents, pa.binary())], names=["sid", "n", "sketch", "content"])

    # Equal sets of different tasks are the same row.
    return docs.select("text").mapInArrow(run, "sid long, n long, sketch array<long>, content binary")


def near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda x: known.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))
    half = lambda k: F.zip_with(F.slice(k, F.lit(1), (F.size(k) / 2).cast("int")), F.slice(k, (F.size(k) / 2).cast("int") + 1, (F.size(k) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    ka, kb = F.col("k_a"), F.col("k_b")
    ka, kb = F.when(F.size(ka) > F.size(kb), half(ka)).otherwise(ka), F.when(F.size(kb) > F.size(ka), half(kb)).otherwise(kb)
    differ = F.aggregate(F.zip_with(ka, kb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return both.withColumn("differ", differ).where(f"differ * {100 + percent} <= {100 - percent} * (n_a + n_b)").select("a", "b", "differ")


def bucket_pairs(rows: DataFrame, sets: DataFrame, percent: int, small: int = SMALL) -> DataFrame:
    """Pairs (a, b) of sets that share a bucket of `rows` (bucket, sid, c) and differ in c: it includes all links."""
    size = staged(rows.groupBy("bucket").count(), "sizes")
    few = rows.join(size.where(F.col("count") <= small).select("bucket"), "bucket")
    side = lambda x: few.select("bucket", F.col("sid").alias(x), F.col("c").alias(f"c_{x}"))
    direct = side("a").join(side("b"), "bucket").where("a < b and c_a <> c_b").select("a", "b")
    many = staged(rows.join(size.where(F.col("count") > small).select("bucket"), "bucket"), "large")
    split = near(rare_pairs(sets, many.select("sid", "c").distinct(), percent), sets.select("sid", "n", "sketch"), percent).select("a", "b")
    split = staged(split, "split")  # few: only then is the bucket asked for
    at = lambda x: many.select(F.col("sid").alias(x), "bucket")
    shared = split.join(at("a"), "a").join(at("b"), ["b", "bucket"]).select("a", "b")
    return direct.unionByName(shared).distinct()


def rare_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in `labels` (sid, c) that differ in c and share one of their rarest shingles so early that a
    link is possible: it includes all links.

    Rarity is counted in 2**RARITY_BITS counters.  A pair's first common shingle, at places i and j counted from 0,
    leaves at most 1 + min(n_a - i - 1, n_b - j - 1) common ones.
    """
    size = 1 << RARITY_BITS
    some = sets.where(Bitmap(labels.select("sid"), "sid").has("sid")).select("sid", "n", "content")

    def tally(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("content"):
                counts += np.bincount((np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["k", "m"])

    # A task for so many sets that its counters are few beside them.
    dealt = some.select("content").coalesce(max(1, -(-sets.count() // TALLY_SETS)))
    rows = dealt.mapInArrow(tally, "k long, m long").groupBy("k").agg(F.sum("m").alias("m")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows.column("k").to_numpy()] = rows.column("m").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = shared.value
        for batch in batches:
            out = []
            for sid, n, x in zip(*(batch.column(k) for k in ("sid", "n", "content")), strict=True):
                s = np.frombuffer(x.as_buffer(), "<u8")
                m = counts[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
                first = np.lexsort((s, m))[: (100 - percent) * len(s) // 100 + 1]
                at = np.flatnonzero(m[first] > 1)  # a counter of 1 is a shingle that no other set has
                if len(at):
                    k = len(at)
                    out.append((s[first[at]], np.full(k, sid.as_py()), np.full(k, n.as_py()), at))
            if out:
                token, sid, n, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(signed(token)), pa.array(sid), pa.array(n), pa.array(at)], names=["token", "sid", "n", "i"])

    entries = staged(some.mapInArrow(run, "token long, sid long, n long, i long").join(labels, "sid"), "rare")
    side = lambda x: entries.select("token", F.col("sid").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "i", "c")])
    could = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * (1 + least(n_a - i_a, n_b - i_b) - 1) >= {percent} * (n_a + n_b)"
    return side("a").join(side("b"), "token").where(f"a < b and c_a <> c_b and {could}").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, compared on the sets themselves."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    sets = sets.where(Bitmap(ids, "sid").has("sid"))
    x = sets.select(F.col("sid").alias("a"), F.col("content").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("content").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """(node, root) over sids: the components of all sets that have a link to another set."""
    members = staged(buckets(signed_rows(docs, width, percent)), "buckets")
    sets = staged(kept_sets(docs, members.select("sid").distinct(), width).dropDuplicates(["sid"]), "sets")
    known = sets.select("sid", "n", "sketch")
    degree = members.groupBy("sid").agg(F.count("*").alias("d"))
    first = members
    members = staged(members.join(degree, "sid"), "members")
    discard(first)
    found, root, tried = None, None, None
    for turn in range(leader_rounds + 1):
        here = members.withColumn("c", F.col("sid"))
        if root is not None:
            here = members.join(root.select(F.col("node").alias("sid"), "root"), "sid", "left").select("bucket", "sid", "d", F.coalesce("root", "sid").alias("c"))
        # first the sets in most buckets, then others
        rank = F.struct(F.lit(0) if turn else -F.col("d"), F.xxhash64("sid", F.lit(turn)), F.col("sid").alias("leader"), F.col("c").alias("leader_c"))
        lead = here.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(rank).alias("l")).where("lo < hi").select("bucket", "l.leader", "l.leader_c")
        last = turn == leader_rounds
        mixed = here.join(lead, "bucket")
        mixed = staged(mixed.select("bucket", "sid", "c") if last else mixed.select("sid", "c", "leader", "leader_c").distinct(), "mixed")
        if mixed.isEmpty():
            break
        if last:
            pairs = bucket_pairs(mixed, sets, percent)
        else:
            pairs = mixed.where("c <> leader_c").select(F.greatest("sid", "leader").alias("b"), F.least("sid", "leader").alias("a"), F.col("sid").alias("y"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if last:
            pairs = near(pairs, known, percent).select("a", "b")
        else:  # one comparison for each set: with the leader whose sketch is nearest, if near enough
            ok = near(pairs.select("a", "b").distinct(), known, percent)
            pairs = pairs.join(ok, ["a", "b"]).groupBy("y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        pairs = staged(pairs, "pairs")
        good = staged(verified(pairs, sets, percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = good if found is None else found.unionByName(good)
        root = staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
        discard(mixed)
    discard(members, sets)
    if root is None:
        return docs.sparkSession.createDataFrame([], "node long, root long")
    return root


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs`."""
    keys = staged(keyed(docs, width), "keys")
    root = links(docs, width, percent, leader_rounds)
    rows = keys.join(root.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("c", F.coalesce("root", "sid"))
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "c", "left").select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs`, all columns kept, without the documents whose class has a smaller doc_id; of rows that repeat a doc_id
    and its text one stays.  Rows with a null doc_id stay."""
    found = staged(classes(docs, width, percent), "classes")
    (copy,) = free_names(docs.columns, "copy")
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
    repeated = found.groupBy("doc_id").count().where("doc_id is not null and count > 1").select(F.col("doc_id").alias(copy))
    touched = Bitmap(copies.unionByName(repeated), copy)
    some = docs.where(touched.has()).join(copies, F.col("doc_id").cast("long") == F.col(copy), "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.where(~touched.has()).unionByName(some)
