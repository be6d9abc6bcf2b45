"""Token-id output (operator 1): best-fit-decreasing packing into rows of a fixed width.

Each document's ids, closed by an end token, are split without loss into pieces of at most `capacity` ids, and pieces
are packed by best-fit decreasing with a segment tree over the sequences' free room.  A task packs the documents of its
own input partition in windows of about `window` ids, so nothing is shuffled and memory is bounded; sequences that are
not nearly full are reopened in the next window, so that only a task's last window leaves some room.

A row is one sequence: its ids as a binary row of the matrix (`capacity` little-endian ids of `id_bytes` bytes, padded
with the end token), the cumulative segment lengths, the positions where position ids start again from 0, and doc_id,
piece number and start of each segment, with which the documents can be put together again (`unpacked`).

Null and empty texts are one end token; null doc_ids and repeated rows are packed like others; an empty table gives no
sequences; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.llm._text import chunks
from transitloom.llm.best_fit import CAPACITY, best_fit_decreasing, cut, place
from transitloom.llm.token_ids import bpe

WINDOW = 4_000_000
NEARLY_FULL = 0.99
RESULT = "sequence_id long, n_tokens int, ids binary, cu_lengths array<int>, resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def packed_ids(docs: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, id_bytes: int = 2, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """The packed sequences of `docs` (doc_id, text); ids must be below 256 ** id_bytes."""

    def rows(items: list, base: int, final: bool):
        """Sequences of the pieces in `items`, and the pieces that stay for the next window."""
        lengths = np.array([len(x[3]) for x in items], dtype=np.int64)
        plan = best_fit_decreasing(np.bincount(lengths, minlength=capacity + 1), capacity)
        sequence, offset = place(lengths, plan)
        order = np.lexsort((offset, sequence))
        bounds = np.flatnonzero(np.diff(sequence[order], prepend=-1, append=-1))
        out, kept = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = [items[i] for i in order[a:b].tolist()]
            ids = np.concatenate([x[3] for x in own])
            if not final and len(ids) < NEARLY_FULL * capacity:
                kept += own
                continue
            cu = np.concatenate([[0], np.cumsum([len(x[3]) for x in own])]).astype(np.int32)
            row = np.full(capacity, end_id, dtype=f"<u{id_bytes}")
            row[: len(ids)] = ids
            out.append((base + len(out), len(ids), row.tobytes(), cu, cu[:-1], [x[0] for x in own], [x[1] for x in own], [x[2] for x in own]))
        return out, kept

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    def run(batches):
        encoder, items, held, next_id = bpe(tokenizer, ranks), [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.array(text, end_id)
                    if len(ids) and int(ids.max()) >= 256**id_bytes:
                        raise ValueError("an id does not fit id_bytes")
                    ids = ids.astype(f"<u{id_bytes}")
                    items += [(doc, k, s, ids[s : s + n]) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                    held += len(ids)
                    if held >= window:
                        out, items = rows(items, next_id, False)
                        next_id += len(out)
                        held = sum(len(x[3]) for x in items)
                        if held >= window // 2:  # hardly anything fits together
                            rest, items = rows(items, next_id, True)
                            out, held, next_id = out + rest, 0, next_id + len(rest)
                        for i in range(0, len(out), 1000):
                            yield batch_of(out[i : i + 1000])
        if items:
            out, _ = rows(items, next_id, True)
            for i in range(0, len(out), 1000):
                yield batch_of(out[i : i + 1000])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the sequences as Parquet: `ids` is one row of the id matrix in each record."""
    packed.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], capacity: int = CAPACITY, id_bytes: int = 2) -> np.ndarray:
    return np.frombuffer(b"".join(ids), dtype=f"<u{id_bytes}").reshape(-1, capacity)


def position_ids(cu_lengths, capacity: int = CAPACITY) -> np.ndarray:
    """Positions that start from 0 at each segment; the padding counts as a segment of its own."""
    starts = np.asarray(cu_lengths, dtype=np.int64)
    begin = np.zeros(capacity + 1, dtype=np.int64)
    begin[starts] = starts
    return np.arange(capacity) - np.maximum.accumulate(begin)[:capacity]


def unpacked(packed: DataFrame, id_bytes: int = 2) -> DataFrame:
    """doc_id, piece, start and ids (array<long>) of every segment."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=f"<u{id_bytes}")
                out += [(d, k, s, ids[a:b].tolist()) for d, k, s, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], r["cu_lengths"][:-1], r["cu_lengths"][1:], strict=True)]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "piece", "start", "ids"])

    return packed.select("ids", "cu_lengths", "doc_ids", "pieces", "starts").mapInArrow(run, "doc_id long, piece int, start long, ids array<long>")
