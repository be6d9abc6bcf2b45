"""Best-fit packing by bin completion (operator 10), and the packing of one group by best-fit decreasing (operator 1).

Documents become pieces of at most `capacity` tokens.  Equal lengths are interchangeable, so all pieces are planned
together, on one histogram of at most `capacity` counters.  Best-fit decreasing gives the first incumbent.  If it uses
more sequences than the lower bound, bin completion branches over the undominated fillings beside the largest remaining
length, nearest fits first, and over how often each is used; it prunes what wastes more than a better solution could, and
keeps each better solution as the new incumbent.  Fillings are enumerated lazily and without a limit of their own; the
search as a whole ends at the bound, when nothing is left, or after `nodes` steps, which `Plan.proven` tells apart.

The plan says which ranks of each length go where.  Pieces are dealt to groups of about `group_size` by hash; the counts
of each length in the groups give each group its first ranks, so that no task sees more than its group.

Nulls and empty texts are documents of one end token; rows with a null doc_id are packed too; repeated rows are packed
as often as they occur; an empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.llm._text import chunks
from transitloom.llm.token_ids import bpe
from transitloom.plans.staging import staged

CAPACITY = 2048
GROUP_SIZE = 250_000
#: Steps of the search for a plan: fillings that are looked at.  Pieces are never left out.
NODES = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


class CapacityTree:
    """A segment tree over capacities: how many bins have each, and the least capacity of at least s that has one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, s: int) -> int:
        """The least capacity >= s with a bin, or -1."""
        i = s + self.leaves
        if self.count[i]:
            return s
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


Pattern = tuple[int, ...]


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: fillings and how often each occurs."""
    tree, bins = CapacityTree(capacity), {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            r = tree.least(s)
            if r < 0:
                per = capacity // s
                full, rest = divmod(left, per)
                for pattern, n in (((s,) * per, full), ((s,) * rest, 1 if rest else 0)):
                    if n:
                        room = capacity - s * len(pattern)
                        bins.setdefault(room, []).append((pattern, n))
                        tree.add(room, n)
                break
            # Once begun, a sequence has the least room that fits and takes all it can; the last one takes the rest.
            pattern, n = bins[r].pop()
            per = r // s
            used = min(n, left // per)
            rest = left - used * per if used < n else 0
            for copies, k in ((per, used), (rest, 1 if rest else 0)):
                if k:
                    bins.setdefault(r - s * copies, []).append(((*pattern, *(s,) * copies), k))
                    tree.add(r, -k)
                    tree.add(r - s * copies, k)
                    left -= k * copies
                    n -= k
            if n:
                bins[r].append((pattern, n))
    return [x for kept in bins.values() for x in kept]


class Plan(NamedTuple):
    """Fillings and how often each occurs; a lower bound on sequences; whether no plan can need fewer."""

    fillings: list[tuple[Pattern, int]]
    bound: int
    proven: bool


def _smeared(bits: int, width: int) -> int:
    """The union of `bits` shifted up by 0 to width - 1."""
    if width <= 0:
        return 0
    done = 1
    while done < width:
        step = min(done, width - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: Pattern, waste: int, left: int) -> bool:
    """Whether an item that is left (bit s of `left` for length s) could take the place of some of the filling's items,
    and be at least as long as all of them together."""
    sums, several = 1, 0  # sums of any items, and of two or more
    for s in filling:
        several |= (sums ^ 1 | several) << s
        sums |= sums << s
    return bool(left & ~1 & (several | _smeared(sums << 1, waste)))


def fillings(counts: np.ndarray, room: int, steps: list[int] | None = None) -> Iterator[Pattern]:
    """All undominated fillings of `room` from the lengths at hand, one item that fits exactly first, then by descending
    items.  Each that is looked at takes one of `steps`; none is given once they are used up."""
    steps = [1 << 62] if steps is None else steps
    # `counts` is read, not copied: whoever changes it restores it before asking for the next filling
    sizes = np.flatnonzero(counts[: room + 1])[::-1].astype(np.int32)
    sizes = sizes[sizes > 0]
    every = sum(1 << s for s in sizes.tolist())
    if not len(sizes):
        yield ()
        return
    if sizes[0] == room:  # it dominates all others
        yield (room,)
        return

    def left_after(filling: Pattern) -> int:
        gone = sum(1 << s for s in set(filling) if filling.count(s) == counts[s])
        return every & ~gone

    stack: list[tuple[Pattern, int, int]] = [((), room, 0)]
    while stack and steps[0] > 0:
        filling, rest, at = stack.pop()
        while at < len(sizes) and (sizes[at] > rest or filling.count(sizes[at]) == counts[sizes[at]]):
            at += 1
        if at < len(sizes):
            stack.append((filling, rest, at + 1))
            stack.append(((*filling, int(sizes[at])), rest - int(sizes[at]), at))
            continue
        steps[0] -= 1
        if filling and not dominated(filling, rest, left_after(filling)):
            yield filling


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any plan needs: for each k, items over capacity - k fill one each, items over half of it one
    each, and what items of k or more do not find room beside those needs more."""
    c = np.asarray(counts, dtype=object)
    at = np.arange(len(c), dtype=object)
    number = np.concatenate([[0], np.cumsum(c)])
    volume = np.concatenate([[0], np.cumsum(c * at)])
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    for k in range(1, half + 1):
        alone = int(number[-1] - number[capacity - k + 1])
        beside, beside_volume = int(number[capacity - k + 1] - number[half + 1]), int(volume[capacity - k + 1] - volume[half + 1])
        rest = int(volume[half + 1] - volume[k]) - (beside * capacity - beside_volume)
        best = max(best, alone + beside + max(0, -(-rest // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> Plan:
    """Fillings of the histogram `counts` (by length, 0 unused) into few bins of `capacity`."""
    counts = np.array(counts, dtype=np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit_decreasing(counts, capacity)
    used, bound, steps = sum(n for _, n in best), lower_bound(counts, capacity), [nodes]

    def choices() -> Iterator[tuple[Pattern, int]]:
        """Fillings with the largest length left, each as often as possible and then less often."""
        a = int(np.flatnonzero(counts)[-1])
        counts[a] -= 1
        for p in fillings(counts, capacity - a, steps):
            counts[a] += 1
            kinds, need = np.unique((a, *p), return_counts=True)
            for times in range(int((counts[kinds] // need).min()), 0, -1):
                yield (a, *p), times
            counts[a] -= 1
        counts[a] += 1

    # One histogram is changed on the way down and restored on the way up, so that a level takes little memory.
    path: list[tuple[Pattern, int]] = []
    stack, waste, bins = [choices()] if total else [], 0, 0
    while stack and used > bound and steps[0] > 0:
        chosen = next(stack[-1], None)
        if chosen is None:
            stack.pop()
            if path:
                p, times = path.pop()
                np.add.at(counts, list(p), times)
                waste, bins = waste - (capacity - sum(p)) * times, bins - times
            continue
        steps[0] -= 1
        p, times = chosen
        lost, made = waste + (capacity - sum(p)) * times, bins + times
        if lost > (used - 1) * capacity - total or made >= used:  # no better solution can waste so much
            continue
        np.subtract.at(counts, list(p), times)
        if counts.any():
            path.append(chosen)
            stack.append(choices())
            waste, bins = lost, made
        else:
            best, used = [*path, chosen], made
            np.add.at(counts, list(p), times)
    return Plan(best, bound, used <= bound or steps[0] > 0)


def place(lengths: np.ndarray, plan: list[tuple[Pattern, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item, items of a length being taken in their order."""
    order = np.argsort(lengths, kind="stable")
    begin = np.searchsorted(lengths[order], np.arange(int(lengths.max(initial=0)) + 2))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    base = 0
    for pattern, times in plan:
        at = 0
        for s in pattern:
            rows = order[begin[s] : begin[s] + times]
            begin[s] += times
            sequence[rows] = base + np.arange(times)
            offset[rows] = at
            at += s
        base += times
    return sequence, offset


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all full but, where n isn't a multiple, a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and a tie-breaker among equal rows."""

    def run(batches):
        encoder = bpe(tokenizer, ranks)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for i, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    ids = encoder.array(text, end_id)
                    rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), i) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Slots:
    """Where each rank of each length goes by a plan."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        begin: dict[int, int] = {}
        slots: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, times in plan:
            at = 0
            for s in pattern:
                rank = begin.get(s, 0)
                slots.setdefault(s, []).append((rank, base, at))
                begin[s] = rank + times
                at += s
            base += times
        self.slots = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for s, rows in slots.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset of some ranks of a length."""
        rank, base, at = self.slots[length]
        k = np.searchsorted(rank, ranks, side="right") - 1
        return base[k] + ranks - rank[k], at[k]


def pack(rows: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to `rows` (a stored table of pieces)."""
    groups = max(1, -(-rows.count() // group_size))
    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(groups)))
    counted = staged(dealt.groupBy("pack_group", "length").count(), "lengths")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("pack_group")) - F.col("count")
    first = counted.select("pack_group", "length", before.alias("first"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row a length
        counts[r["length"]] = r["n"]
    shared = rows.sparkSession.sparkContext.broadcast(Slots(bin_completion(counts, capacity, nodes).fillings))

    def run(t, firsts):
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32", "tie")])
        lengths = t.column("length").to_numpy()
        start = dict(zip(firsts.column("length").to_pylist(), firsts.column("first").to_pylist(), strict=True))
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(own):
                s = int(lengths[own[0]])
                sequence[own], offset[own] = shared.value.of(s, start[s] + np.arange(len(own)))
        t = t.drop_columns(["tie", "pack_group"])
        return t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").cogroup(first.groupBy("pack_group")).applyInArrow(run, out)


def packed(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenise `docs` (doc_id, text) and pack all pieces; see the module's text."""
    group_size, nodes = options.pop("group_size", GROUP_SIZE), options.pop("nodes", NODES)
    return pack(staged(pieces(docs, capacity, **options), "pieces"), capacity, group_size, nodes)
