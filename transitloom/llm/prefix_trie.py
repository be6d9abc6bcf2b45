"""Conversation prefix trie: which conversations begin alike, and what a shared prefix saves.

A node is a distinct sequence of the first d turns (role, text); the root has none.  Turns are dealt to tasks by ranges of
(conversation, place), so a conversation may lie in many tasks.  Each task scans its turns with numpy: a polynomial rolling
fingerprint of all turns of the conversation so far, their number and their characters.  What a conversation brought along
from the tasks before is added from one small record a task.  Rows of equal depth and fingerprint are candidates for one
node; each is verified against its representative, turn by turn: all texts of a node must be equal, and all its rows must
come from one parent.  Where they aren't, the turns of that node get another hash and the scan is run again, until all nodes
are verified.

The parent rollup needs no loop over depths.  Let q be the least depth at which a conversation is the smallest member of its
node; it stays the smallest below.  With a = the characters of its turns before q, a node of n members at depth d has

    saved = sum of its members' a - (n - 1) * (characters of its first d - 1 turns) - (a of its smallest member)

and as many leaves as members that are the smallest of a childless node.

Defined cases: rows without conv_id are dropped; null role or text is an empty string; turns are ordered by (turn, role,
text), nulls first; repeated rows are turns of their own; an empty table has no node, not even a root; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.llm._text import _Powers, mix, signed
from transitloom.plans.staging import discard, staged

#: Turns at most that a rebuilt conversation takes from the first one of its block of a hundred.
HEAD = 5
#: Rounds of new hashes for nodes that failed; one is more than 64-bit fingerprints are ever expected to need.
ROUNDS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = _Powers(_BASE)
_SCANNED = "pid int, conv long, src long, k long, f long, p long, l long, prior long"
_ROWS = "conv long, src long, d long, f long, p long, l long, prior long"
_NODE = ["d", "f"]


@dataclass
class Trie:
    """`nodes`: d, f (a fingerprint, with d the node's key), conv_id, n_convs, parent_conv_id, n_children, n_leaves,
    saved_tokens and src (a turn of `turns` that is the node's last one).  `ends`: d, f and conv of each conversation that
    ends at a node.  `turns`: uid, conv, role, text."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def ordered(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """(uid, conv, role, text, t, n): turns with ids that ascend in the order of (conv, turn, role, text), a hash of `bits`
    bits and the number of code points."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role"), text("text"))
    rows = rows.repartitionByRange("conv", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    hashed = F.shiftrightunsigned(F.xxhash64("role", "text"), 64 - bits) if bits < 64 else F.xxhash64("role", "text")
    return staged(rows.select(F.monotonically_increasing_id().alias("uid"), "conv", "role", "text", hashed.alias("t"), F.length("text").cast("long").alias("n")), "turns")


def _roots(turns: DataFrame) -> DataFrame:
    return turns.select("conv").distinct().select("conv", F.lit(-100).cast("long").alias("ord"), F.lit(None).cast("long").alias("src"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n"))


def plain(turns: DataFrame) -> DataFrame:
    """(conv, ord, src, t, n): the turns as they are, with a root row for each conversation."""
    return turns.select("conv", F.col("uid").alias("ord"), F.col("uid").alias("src"), "t", "n").unionByName(_roots(turns))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, ord, src, t, n): the first h turns of conversation c - c % 100, then those of c after its own first h, with
    h = crc32(decimal c) % 6."""
    h = F.crc32(F.col("conv").cast("string")) % (HEAD + 1)
    place = Window.partitionBy("conv").orderBy("uid")
    # at most HEAD rows of a conversation leave a task
    heads = turns.select("conv", "uid", "t", "n").withColumn("i", F.row_number().over(place)).where(F.col("i") <= HEAD)
    own = turns.join(heads.where(F.col("i") <= h).select("uid"), "uid", "left_anti").select("conv", F.col("uid").alias("ord"), F.col("uid").alias("src"), "t", "n")
    bases = heads.where("conv % 100 = 0").select(F.col("conv").alias("base"), "i", F.col("uid").alias("src"), "t", "n")
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), h.alias("h"))
    taken = convs.join(bases, "base").where("i <= h").select("conv", (F.col("i") - 50).cast("long").alias("ord"), "src", "t", "n")
    return own.unionByName(taken).unionByName(_roots(turns))


def _scan(batches):
    """Each row with its place k in its conversation, counted from 0 in this task, the fingerprints f and p with and without
    it and the characters l and prior with and without it."""
    pid = TaskContext.get().partitionId()
    conv, count, f, chars = None, 0, np.uint64(0), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        c = col("conv")
        t, size = mix(col("t").view(np.uint64) ^ np.uint64(_BASE)), col("n")
        t[batch.column("src").is_null().to_numpy(zero_copy_only=False)] = 0  # roots
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        width = np.diff(np.append(head, n))
        first = np.repeat(head, width)
        k = np.arange(n) - first
        up, down = _POWERS.get(n + 2)
        at = np.arange(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * down[at])])
            local = (sums[1:] - sums[first]) * up[at]
            local_chars = np.cumsum(size) - (np.cumsum(size) - size)[first]
            if c[0] == conv:  # the batch before has begun this conversation
                w = width[0]
                local[:w] += f * up[k[:w] + 1]
                local_chars[:w] += chars
                k[:w] += count
            before, chars_before = np.empty_like(local), local_chars - size
            before[1:] = local[:-1]
            before[head] = 0
            if c[0] == conv:
                before[0] = f
        conv, count, f, chars = c[-1], int(k[-1]) + 1, local[-1], int(local_chars[-1])
        yield pa.record_batch([pa.array(np.full(n, pid, np.int32)), pa.array(c), batch.column("src"), pa.array(k), pa.array(signed(local)), pa.array(signed(before)), pa.array(local_chars), pa.array(chars_before)], names=[x.split()[0] for x in _SCANNED.split(", ")])


def _carries(scanned: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each task whose first conversation began before it: (conversation, number of turns, fingerprint, characters)
    brought along.  One record a task comes to the driver."""
    ends = scanned.groupBy("pid").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "k", "f", "l")).alias("last")).orderBy("pid").collect()
    out, held = {}, None
    for r in ends:
        conv, k, f, chars = r["last"]
        n, f = k + 1, f % (1 << 64)
        if held and held[0] == r["first"]:
            out[r["pid"]] = held
            if conv == r["first"]:
                n, f, chars = n + held[1], (held[2] * pow(_BASE, n, 1 << 64) + f) % (1 << 64), chars + held[3]
        held = (conv, n, f, chars)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """(conv, src, d, f, p, l, prior) of (conv, ord, src, t, n): depth, fingerprints and characters in whole conversations."""
    scanned = staged(rows.repartitionByRange("conv", "ord").sortWithinPartitions("conv", "ord").mapInArrow(_scan, _SCANNED), "scanned")
    carries = _carries(scanned)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = {x: batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("pid", "conv", "k", "f", "p", "l", "prior")}
            f, p = a["f"].view(np.uint64), a["p"].view(np.uint64)
            for pid in np.unique(a["pid"]).tolist():
                if pid in carries:
                    conv, n, brought, chars = carries[pid]
                    at = np.flatnonzero((a["pid"] == pid) & (a["conv"] == conv))
                    if not len(at):
                        continue
                    up = _POWERS.get(int(a["k"][at].max()) + 2)[0]
                    f[at] += np.uint64(brought) * up[a["k"][at] + 1]
                    p[at] += np.uint64(brought) * up[a["k"][at]]
                    for x, more in (("k", n), ("l", chars), ("prior", chars)):
                        a[x][at] += more
            yield pa.record_batch([pa.array(a["conv"]), batch.column("src"), *(pa.array(a[x]) for x in ("k", "f", "p", "l", "prior"))], names=[x.split()[0] for x in _ROWS.split(", ")])

    placed = staged(scanned.mapInArrow(run, _ROWS), "placed")
    discard(scanned)
    return placed


def _candidates(rows: DataFrame) -> DataFrame:
    return staged(rows.groupBy(*_NODE).agg(F.count("*").alias("n"), F.min("conv").alias("rep"), F.min("src").alias("src"), F.max("src").alias("other"), F.min("p").alias("p"), F.max("p").alias("q"), F.min("prior").alias("prior")), "candidates")


def _failed(rows: DataFrame, candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """(uid): turns of candidates that hold unequal texts or parents; those of one source are equal without a look."""
    mixed = rows.join(candidates.where("src <> other").select(*_NODE), _NODE, "left_semi").select(*_NODE, "src").distinct()
    content = F.struct("role", "text")
    seen = mixed.join(turns, F.col("src") == F.col("uid")).groupBy(*_NODE).agg(F.min(content).alias("least"), F.max(content).alias("most"))
    bad = seen.where("least <> most").select(*_NODE).unionByName(candidates.where("p <> q").select(*_NODE))
    return rows.join(bad, _NODE, "left_semi").where("src is not null").select(F.col("src").alias("uid")).distinct()


def trie(conversations: DataFrame, rebuild: bool = False, bits: int = 64) -> Trie:
    """The trie of `conversations` (conv_id, turn, role, text), rebuilt as `rebuilt` says if asked for."""
    turns = ordered(conversations, bits)
    for k in range(ROUNDS):
        rows = _placed(rebuilt(turns) if rebuild else plain(turns))
        candidates = _candidates(rows)
        failed = staged(_failed(rows, candidates, turns), "failed")
        if failed.isEmpty():
            break
        split = F.when(F.col("anew"), F.xxhash64("role", "text", F.lit(k))).otherwise(F.col("t"))
        before, turns = turns, staged(turns.join(failed.withColumn("anew", F.lit(True)), "uid", "left").select("uid", "conv", "role", "text", split.alias("t"), "n"), "turns")
        discard(before, rows, candidates)
    else:
        raise RuntimeError("nodes could not be told apart")
    return Trie(_rolled_up(rows, candidates), _ends(rows), turns)


def _ends(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv").agg(F.max(F.struct(*_NODE)).alias("e")).select("e.d", "e.f", "conv")


def _rolled_up(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    children = candidates.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p").alias("f")).agg(F.count("*").alias("n_children"))
    nodes = staged(candidates.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # the node where a conversation becomes the smallest member, and what its turns before hold
    tops = nodes.groupBy(F.col("rep").alias("conv")).agg(F.min(F.struct("d", "f", "p", F.col("prior").alias("a"))).alias("top"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    whole = rows.groupBy("conv").agg(F.max("l").alias("l"))
    own = staged(whole.join(tops, "conv", "left").select("conv", "top", F.coalesce("top.a", "l").alias("a"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "own")
    sums = rows.select("conv", *_NODE).join(own.select("conv", "a", "leaf"), "conv").groupBy(*_NODE).agg(F.sum("a").alias("sum_a"), F.sum("leaf").alias("n_leaves"), F.min(F.struct("conv", "a"))["a"].alias("rep_a"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("f").alias("p"), F.col("rep").alias("parent"))
    entered = own.where("top.d > 0").select("top.d", "top.f", "top.p").join(parents, ["d", "p"]).select(*_NODE, "parent")
    joined = nodes.join(sums, _NODE).join(entered, _NODE, "left")
    saved = F.col("sum_a") - (F.col("n") - 1) * F.col("prior") - F.col("rep_a")
    return joined.select(*_NODE, F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.when(F.col("d") > 0, F.coalesce("parent", "rep")).alias("parent_conv_id"), "n_children", "n_leaves", saved.alias("saved_tokens"), "src")


def _digests(batches):
    """The SHA-256 of each node's ids, which arrive in order; none is held but the running hash."""
    node, state = None, None
    for batch in batches:
        done = []
        d, f, c = (batch.column(x).to_pylist() for x in ("d", "f", "conv"))
        a = 0
        while a < len(d):
            b = a + 1
            while b < len(d) and f[b] == f[a] and d[b] == d[a]:
                b += 1
            if (d[a], f[a]) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (d[a], f[a]), hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, c[a:b])).encode())
            a = b
        if done:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["d", "f", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], names=["d", "f", "ends_sha256"])


def report(t: Trie) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ends = t.ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv").mapInArrow(_digests, "d long, f long, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return t.nodes.join(ends, _NODE, "left").select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
