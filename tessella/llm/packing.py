"""Packing documents into fixed-length sequences, shortest pack first.

A document's ids (with the end id) are cut into full pieces of `limit` ids and a
rest.  Only the histogram of piece lengths (at most `limit` numbers) reaches the
driver: lengths are placed longest first, each into the pack with the most space
left, and a pack is a pattern with a count, so the work there depends on `limit`
and not on the corpus.  A piece finds its place by its rank among the pieces of
its length: its rank within its task, which the task itself counts, plus the
counts of the tasks before it.

Null and empty texts are the end id alone.  Repeated rows are packed each for
itself, in the order read; an empty table gives no rows; a very long text is many
full pieces; of other columns nothing is read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import _common as C
from tessella.llm._encode import shared_encoder, slices_of

LIMIT, END_ID = 2048, 1


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    full = n - n % limit
    return [(at, limit) for at in range(0, full, limit)] + ([(full, n - full)] if n > full else [])


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, first rank)]): the j-th sequence of a pattern
    takes, of each length, the piece whose rank is the first rank plus j."""
    spaces: list[int] = []  # sorted
    packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(space: int, pack: tuple[int, list[tuple[int, int]]]) -> None:
        if space not in packs:
            bisect.insort(spaces, space)
            packs[space] = []
        packs[space].append(pack)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not spaces or spaces[-1] < length:
                put(limit - length, (left, [(length, rank)]))
                break
            space = spaces[-1]
            count, items = packs[space].pop()
            if not packs[space]:
                del packs[space]
                spaces.pop()
            k = min(left, count)
            if count > k:
                put(space, (count - k, [(x, r + k) for x, r in items]))
            put(space - length, (k, [*items, (length, rank)]))
            left, rank = left - k, rank + k
    return [p for s in sorted(packs) for p in packs[s]]


class Places:
    """Where the piece of a length and rank goes: sequence and offset."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for count, items in patterns:
            offset = 0
            for length, rank in items:
                by.setdefault(length, []).append((rank, base, offset))
                offset += length
            base += count
        self.by = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in by.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        values, starts = np.unique(lengths[order], return_index=True)
        for length, rows in zip(values.tolist(), np.split(order, starts[1:])):
            first, base, at = self.by[length]
            i = np.searchsorted(first, ranks[rows], "right") - 1
            sequence[rows] = base[i] + ranks[rows] - first[i]
            offset[rows] = at[i]
        return sequence, offset


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, task_rank long"


def pieces_of(docs: DataFrame, path: str, style: str, end_id: int, limit: int) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its task."""
    end = np.array([end_id], "<u4")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        encoder, seen, task = shared_encoder(path, style), Counter(), TaskContext.get().partitionId()
        for b in batches:
            keys, at = b.column("doc_id").to_pylist(), 0
            for texts in slices_of(b.column("text")):
                ids, _ = encoder.encode(texts)
                rows = []
                for k, doc_id in enumerate(keys[at : at + len(texts)]):
                    raw = memoryview(np.concatenate((ids.flat[ids.start[k] : ids.start[k + 1]], end)).astype("<u4").tobytes())
                    n = len(raw) // 4
                    for start, length in cuts(n, limit):
                        rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, task, seen[length]))
                        seen[length] += 1
                at += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, style: str = "words", end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """docs: doc_id, text.  A row for each piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = C.stored(pieces_of(docs, path, style, end_id, limit), "pack-pieces")
    tasks = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    told = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram, limit)))
    ranked = pieces.join(tasks.drop("n"), ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("task_rank")).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches):
        for b in batches:
            sequence, offset = told.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
