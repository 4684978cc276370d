"""Best-fit packing by minimum bin slack over the histogram of lengths.

Whole documents become token pieces of at most `capacity` ids; only longer ones are cut. What the packer
plans over is the count of pieces of each length, at most `capacity` numbers however large the input, so the
plan is exact for all pieces and bounded. For each bin the longest length left is fixed and a bitset
subset-sum over the lengths available (each as often as it is left) finds the fullest feasible rest; the
combination is then taken as many times as its counts allow and removed.

Pieces get their numbers within a length by counts of (partition, length) and a running sum, never by a
sort of all pieces in one task; the plan turns a number into a sequence and an offset.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import in_batches, slices, text_bytes, written
from lodestrata.llm.token_ids import vocabulary, word_tokens
from lodestrata.session import table

CAPACITY = 2048


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths left whose sum comes nearest to room from below."""
    full, reach, steps = 1 << room, 1, []
    mask = (full << 1) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, part = min(left[length], room // length), 1
        while copies > 0:
            n = min(part, copies)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            copies, part = copies - n, part * 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            taken[length] = taken.get(length, 0) + n
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often in a bin}), longest first; every piece is in exactly one bin."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            bin_ = fullest({k: v for k, v in left.items() if v}, capacity - longest) if longest < capacity else {}
            left[longest] += 1
            bin_[longest] = bin_.get(longest, 0) + 1
            times = min(left[k] // n for k, n in bin_.items())
            for k, n in bin_.items():
                left[k] -= times * n
                if not left[k]:
                    del left[k]
            out.append((times, bin_))
    return out


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its part and number among its length there.

    Null text is empty: one piece with the end id alone. Every row is a document of its own, also where
    doc_ids repeat or are null.
    """
    path = path or vocabulary()

    def pieces(batches):
        from pyspark import TaskContext

        part, tokens, end = TaskContext.get().partitionId(), word_tokens(path), struct.pack("<I", end_id)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids = tokens.encode(text) + end
                for piece in range(-(-len(ids) // (4 * capacity))):
                    own = ids[4 * capacity * piece : 4 * capacity * (piece + 1)]
                    n = len(own) // 4
                    for column, v in zip(rows, (doc, piece, piece * capacity, n, zlib.crc32(own), part, int(seen[n])), strict=True):
                        column.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(source, pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (as a written table) with sequence_id and offset."""
    each = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = each.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("base"))
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, bins, copies, offsets, first, used = [], [], [], [], 0, {}
    for times, bin_ in plan(counts, capacity):
        at = 0
        for length, n in sorted(bin_.items(), reverse=True):
            keys.append(length << 44 | used.get(length, 0))
            bins.append(first)
            copies.append(n)
            offsets.append(at)
            used[length] = used.get(length, 0) + times * n
            at += length * n
        first += times
    order = np.argsort(np.array(keys, np.int64))
    keys_, bins_, copies_, offsets_ = (np.array(x, np.int64)[order] for x in (keys, bins, copies, offsets))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("base").to_numpy() + b.column("number").to_numpy()
            i = np.searchsorted(keys_, length << 44 | rank, side="right") - 1
            own = rank - (keys_[i] & ((1 << 44) - 1))
            more = [bins_[i] + own // copies_[i], offsets_[i] + own % copies_[i] * length]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(b.column(c) for c in names), *map(pa.array, more)], [*names, "sequence_id", "offset"])

    both = pieces.join(bases, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    return both.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of docs with its sequence and its place there. Empty input gives no rows."""
    return placed(written(cut(docs, path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, placement: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """sequence_id and the ids of each packed sequence, for docs whose doc_ids are unique and not null.

    Null text is empty. A row with a null doc_id has no place and is left out; rows that repeat one would each take its place. An empty
    placement gives no rows.
    """
    path = path or vocabulary()

    def encode(batches):
        tokens, end = word_tokens(path), struct.pack("<I", end_id)
        for batch in slices(batches):
            out = [[], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids = tokens.encode(text) + end
                for piece in range(-(-len(ids) // (4 * capacity))):
                    for column, v in zip(out, (doc, piece, ids[4 * capacity * piece : 4 * capacity * (piece + 1)]), strict=True):
                        column.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["doc_id", "piece", "ids"])

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, piece int, ids binary")
    joined = parts.join(placement, ["doc_id", "piece"])
    one = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))  # a sequence holds `capacity` ids at most
    return joined.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(one, lambda x: x["ids"]), "")).alias("ids"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
