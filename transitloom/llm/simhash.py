"""SimHash near-duplicates by deletion variants of segments.

A fingerprint bit is set if it is set in over half of the hashes of a text's shingles, repeats included.  Two fingerprints
that differ in at most four bits have, of three segments, one that differs in at most one.  So each distinct fingerprint is
indexed by its three segments, once as they are and once with each bit as a wildcard: 67 signatures.  Fingerprints that share
a signature are compared as a whole; in a wildcard's bucket only those that differ in that bit, as the others meet in the
bucket of the segment itself.

Signatures are sorted by Spark and streamed through each task, so no bucket is held beyond BUCKET members.  A larger one is
only chained along its order and left to a second look.  That asks for one of five parts of the other bits to be equal too
(four differences cannot touch all five), and compares only fingerprints which the first look hasn't joined yet.  Buckets
that are large even so are cut into blocks, and blocks are compared in pairs, each pair in a group of its own.  Only links of
a spanning forest leave a task.

Defined cases: a null or empty text, or one without words, has the fingerprint zero, which links like any other; rows without
doc_id get a component, but their null id is no component's name (it is null if no other is reachable); repeated rows are
kept; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._text import LOWER, NOT_SPACE, Text, chunks, signed
from transitloom.plans.components import components
from transitloom.plans.staging import discard, staged

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Members of a bucket that a task compares at once.
BUCKET = 4096
#: Bits of the three segments; any segment of two fingerprints within DISTANCE differs in one bit at most, or another does.
SEGMENTS = [range(0, 22), range(22, 43), range(43, 64)]
PARTS = 5
_BLOCK = 1 << 15
_ALL = (1 << 64) - 1


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Per signature: the bits that must be equal, and the wildcard as a mask (0: none).
VARIANTS = [(_mask(s), 0) for s in SEGMENTS] + [(_mask(s) & ~(1 << b), 1 << b) for s in SEGMENTS for b in s]
_WILD = np.array([w for _, w in VARIANTS], dtype=np.uint64)


def _parts(segment: range) -> list[int]:
    """Masks of PARTS parts of the bits outside a segment."""
    rest = [b for b in range(64) if b not in segment]
    return [_mask(rest[k::PARTS]) for k in range(PARTS)]


#: Per signature: the masks of PARTS parts of the bits outside its segment.
VARIANT_PARTS = [_parts(s) for s in SEGMENTS] + [_parts(s) for s in SEGMENTS for _ in s]


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    words = Text(texts).words(NOT_SPACE, LOWER)
    inside = NOT_SPACE[words.data]
    after = np.append(False, inside[:-1]) & ~inside
    at = np.cumsum(inside | after)  # places in the words joined by single bytes
    joined = words.data[inside | after].copy()
    if len(words.start):
        start, end = at[words.start] - 1, at[words.end - 1]
        joined[np.minimum(end, len(joined) - 1)] = 32
    view, of = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            continue
        k = min(width, b - a)
        first, last = start[a : b - k + 1].tolist(), end[a + k - 1 : b].tolist()
        ones = np.zeros(64, np.int64)
        for j in range(0, len(first), _BLOCK):
            h = np.array([of(view[x:y], SEED) for x, y in zip(first[j : j + _BLOCK], last[j : j + _BLOCK], strict=True)], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(first), bitorder="little")
        out[i] = bits.view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text, as a long."""

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                yield pa.record_batch([piece.column("doc_id"), pa.array(signed(_fingerprints(piece.column("text"), width)))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, wild: int, distance: int, group: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket: (place, place) of fingerprints within `distance`, which differ in the bit
    `wild` if there is one, in their `group` if they have one, and in their `side` if they have one."""
    sides = [x for x in ((fp & np.uint64(wild)) != 0 if wild else None, side) if x is not None]
    label, out = np.arange(len(fp)) if group is None else np.unique(group, return_inverse=True)[1].copy(), []
    for a in range(len(fp) - 1):
        near = (np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= distance) & (label[a + 1 :] != label[a])
        for x in sides:
            near &= x[a + 1 :] != x[a]
        at = np.flatnonzero(near) + a + 1
        while len(at):
            out.append((a, int(at[0])))
            label[label == label[at[0]]] = label[a]
            at = at[label[at] != label[a]]
    return out


class _Stream:
    """Rows sorted by key, batch by batch: whole buckets of up to `limit` rows, and pieces of larger ones."""

    def __init__(self, keys: list[str], limit: int):
        self.keys, self.limit = keys, limit

    def buckets(self, batches):
        """(columns by name, first places of the buckets, whether the bucket is larger than the limit)."""
        held, key = None, None  # rows of the last bucket of the batches before; the key of a larger one under way
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            n = len(rows[self.keys[0]])
            new = np.zeros(n, bool)
            for c in self.keys:
                new[1:] |= rows[c][1:] != rows[c][:-1]
            new[0] = True
            heads = np.flatnonzero(new)
            if key is not None and tuple(rows[c][0] for c in self.keys) == key:
                to = heads[1] if len(heads) > 1 else n
                yield {c: x[:to] for c, x in rows.items()}, None
                if to == n:
                    held = None
                    continue
                rows, heads = {c: x[to:] for c, x in rows.items()}, heads[1:] - to
                n -= to
            key = None
            last = heads[-1]
            if n - last > self.limit:
                key = tuple(rows[c][last] for c in self.keys)
                yield {c: x[last:] for c, x in rows.items()}, None
                held = None
            else:
                held = {c: x[last:] for c, x in rows.items()}
            yield from self._split({c: x[:last] for c, x in rows.items()}, heads[:-1])
        if held is not None:
            yield from self._split(held, np.zeros(1, np.int64))

    def _split(self, rows, heads):
        """Buckets of two or more; those beyond the limit one by one."""
        n = len(rows[self.keys[0]])
        sizes = np.diff(np.append(heads, n))
        for a, w in zip(heads[sizes > self.limit].tolist(), sizes[sizes > self.limit].tolist(), strict=True):
            yield {c: x[a : a + w] for c, x in rows.items()}, None
        fit = (sizes > 1) & (sizes <= self.limit)
        if fit.any():
            yield rows, np.stack([heads[fit], sizes[fit]], axis=1)


def _pairs_of(rows, buckets, distance, wild_of):
    """Links (fp, fp) of whole buckets."""
    fp = rows["fp"].view(np.uint64)
    two = buckets[buckets[:, 1] == 2, 0]
    a, b = fp[two], fp[two + 1]
    wild = wild_of(rows, two)
    near = (np.bitwise_count(a ^ b) <= distance) & ((wild == 0) | (((a ^ b) & wild) != 0))
    if "comp" in rows:
        near &= rows["comp"][two] != rows["comp"][two + 1]
    u, v = [a[near]], [b[near]]
    for at, n in buckets[buckets[:, 1] > 2].tolist():
        own = fp[at : at + n]
        links = _forest(own, int(wild_of(rows, np.array([at]))[0]), distance, rows["comp"][at : at + n] if "comp" in rows else None)
        if links:
            x = np.array(links)
            u.append(own[x[:, 0]])
            v.append(own[x[:, 1]])
    return np.concatenate(u), np.concatenate(v)


def _out(u, v, w=None, m=None, part=None):
    """Links have a null w; rows of large buckets have v = the fingerprint."""
    n = len(v)
    long = lambda x: pa.array(signed(np.ascontiguousarray(x)) if x.dtype == np.uint64 else x) if x is not None else pa.nulls(n, pa.int64())
    return pa.record_batch([long(u), long(v), pa.array(w, pa.int32()) if w is not None else pa.nulls(n, pa.int32()), long(m), pa.array(part, pa.int32()) if part is not None else pa.nulls(n, pa.int32())], names=["u", "v", "w", "m", "part"])


_OUT = "u long, v long, w int, m long, part int"


def _first_look(limit: int, distance: int):
    def run(batches):
        for rows, buckets in _Stream(["w", "m"], limit).buckets(batches):
            if buckets is not None:
                u, v = _pairs_of(rows, buckets, distance, lambda r, at: _WILD[r["w"][at]])
                if len(u):
                    yield _out(u, v)
                continue
            fp = rows["fp"].view(np.uint64)
            near = np.bitwise_count(fp[1:] ^ fp[:-1]) <= distance  # sorted by fp: neighbours share high bits
            if near.any():
                yield _out(fp[1:][near], fp[:-1][near])
            yield _out(None, rows["fp"], rows["w"], rows["m"])

    return run


def _second_look(limit: int, distance: int):
    def run(batches):
        for rows, buckets in _Stream(["w", "m", "part", "value"], limit).buckets(batches):
            if buckets is not None:
                u, v = _pairs_of(rows, buckets, distance, lambda r, at: _WILD[r["w"][at]])
                if len(u):
                    yield _out(u, v)
            else:
                yield _out(rows["comp"], rows["fp"], rows["w"], rows["m"], rows["part"])

    return run


def _block_links(distance: int):
    """Links between two blocks of a bucket, or within one: a group has twice BUCKET members or so."""

    def run(table: pa.Table) -> pa.Table:
        fp, comp = (table.column(c).to_numpy().copy() for c in ("fp", "comp"))
        i, j, side = (table.column(c)[0].as_py() if c != "block" else table.column(c).to_numpy() for c in ("i", "j", "block"))
        fp = fp.view(np.uint64)
        links = _forest(fp, int(_WILD[table.column("w")[0].as_py()]), distance, comp, side if i != j else None)
        x = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(signed(fp[x[:, 0]])), "v": pa.array(signed(fp[x[:, 1]]))})

    return run


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links of distinct fingerprints (fp) that connect all those within `distance` of each other."""
    if distance > 2 * len(SEGMENTS) - 2 or distance >= PARTS:
        raise ValueError("the segments are for four differing bits at most")
    masks = F.array(*[F.lit(_long(m)) for m, _ in VARIANTS])
    signatures = prints.select("fp", F.posexplode(masks).alias("w", "m")).select("w", F.col("fp").bitwiseAND(F.col("m")).alias("m"), "fp")
    first = staged(signatures.repartition("w", "m").sortWithinPartitions("w", "m", "fp").mapInArrow(_first_look(bucket, distance), _OUT), "first")
    found = first.where("w is null").select("u", "v")
    large = first.where("w is not null")
    if large.isEmpty():
        return found
    joined = components(found)
    large = large.select("w", "m", F.col("v").alias("fp")).join(joined, F.col("fp") == F.col("node"), "left").select("w", "m", "fp", F.coalesce("root", "fp").alias("comp"))
    parts = F.array(*[F.array(*[F.lit(_long(x)) for x in p]) for p in VARIANT_PARTS])
    # a bucket whose members are all joined already needs no second look
    open_ = large.groupBy("w", "m").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("w", "m")
    split = large.join(open_, ["w", "m"]).select("w", "m", "fp", "comp", F.posexplode(F.get(parts, F.col("w"))).alias("part", "value")).withColumn("value", F.col("fp").bitwiseAND(F.col("value")))
    second = staged(split.repartition("w", "m", "part", "value").sortWithinPartitions("w", "m", "part", "value", "fp").mapInArrow(_second_look(bucket, distance), _OUT), "second")
    found = found.unionByName(second.where("w is null").select("u", "v"))
    rest = second.where("w is not null")
    if rest.isEmpty():
        return found
    key = ["w", "m", "part", "value"]
    rest = rest.select("w", "m", "part", F.col("v").alias("fp"), F.col("u").alias("comp")).withColumn("value", F.col("fp").bitwiseAND(F.get(F.get(parts, F.col("w")), F.col("part"))))
    sizes = rest.groupBy(*key).agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select(*key, F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
    blocks = rest.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    pairs = blocks.select(*key, "fp", "comp", "block", F.inline(meet))
    return found.unionByName(pairs.groupBy(*key, "i", "j").applyInArrow(_block_links(distance), "u long, v long"))


def classes(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; a component is a set of fingerprints joined by links."""
    own = staged(fingerprints(docs, width), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(least.select("fp"), distance, bucket))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(top, "root").select("fp", "component_id")
    discard(least)
    return own.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
