"""Token-id output as wavelet matrices: one compressed file for each shard.

A shard's ids are kept as bit-planes, the highest bit first; below each plane
the ids are parted stably into zeros and ones.  A plane with its rank directory
(ones before every 512th bit) answers access, rank and select, and through them
token access, counting and occurrence lookup; a whole shard is read back from
the lowest plane up.

Documents are dealt to tasks by ranges of doc_id, so shards hold documents in
ascending order; a shard is closed at `shard_ids` ids, whatever a document's
length.  A file is written by Spark as a Parquet file of one row, so that any
store works and a lost task is simply written again.

Null text counts as empty: the end id alone.  Repeated doc_ids stand together,
ordered by a hash of their text and the text; null ids come first; a very long
text is a shard of its own; an empty table gives no files; of other columns
nothing is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import _common as C
from tessella.llm._encode import shared_encoder, slices_of

#: Ids of a shard, bits between two ranks, bytes of a plane that are compressed together.
SHARD_IDS, BLOCK, FILE_BLOCK, END_ID = 1 << 20, 512, 1 << 14, 0
_HEAD = struct.Struct("<4sIQQ")  # name, bits, ids, documents


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        n = len(ids)
        bits = bits or max(1, int(ids.max()).bit_length() if n else 1)
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for s in range(bits - 1, -1, -1):
            bit = (a & (1 << s)) != 0
            plane = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate((plane, np.zeros(-len(plane) % 64, np.uint8))))
            ones = a[bit]
            zeros.append(n - len(ones))
            ranks.append(cls._directory(planes[-1]))
            a = np.concatenate((a[~bit], ones))
        return cls(n, bits, planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        blocks = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)))

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        b = i // BLOCK
        part = self.planes[level][b * BLOCK // 8 : -(-i // 8)]
        if not len(part):
            return int(self.ranks[level][b])
        last = i - b * BLOCK - 8 * (len(part) - 1)
        return int(self.ranks[level][b]) + int(np.bitwise_count(part[:-1]).sum()) + (int(part[-1]) & ((1 << last) - 1)).bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = (int(self.planes[level][i >> 3]) >> (i & 7)) & 1
            out = out << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i ids stand below the last plane."""
        start, end = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences among the first i ids (all)."""
        if token >> self.bits:
            return 0
        start, end = self._range(token, self.n if i is None else i)
        return end - start

    def occurrence(self, token: int, k: int) -> int:
        """The place of the token's k-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        kind = np.uint16 if self.bits <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(np.asarray(self.planes[level]), count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            here = np.empty(self.n, kind)
            here[~bit] = below[:z]
            here[bit] = below[z:] | kind(1 << (self.bits - 1 - level))
            below = here
        return below

    def to_bytes(self, lengths: np.ndarray) -> bytes:
        """The file: head, sizes of what follows, then the compressed directory (zeros,
        document lengths, ranks) and the planes in blocks compressed one by one."""
        directory = [np.array(self.zeros, "<u8").tobytes(), lengths.astype("<u4").tobytes(), *(r.astype("<u4").tobytes() for r in self.ranks)]
        press = zstandard.ZstdCompressor(level=1).compress
        packed = [press(b"".join(directory)), *(press(p[at : at + FILE_BLOCK].tobytes()) for p in map(np.asarray, self.planes) for at in range(0, len(p), FILE_BLOCK))]
        sizes = np.array([len(x) for x in packed], "<u4")
        return _HEAD.pack(b"TWM2", self.bits, self.n, len(lengths)) + sizes.tobytes() + b"".join(packed)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        """The matrix of a file, and its documents' lengths; planes are unpacked block by block, when they are asked for."""
        name, bits, n, docs = _HEAD.unpack_from(raw)
        if name != b"TWM2":
            raise ValueError("not a wavelet file")
        size = -(-n // 8)
        size += -size % 64
        per = -(-size // FILE_BLOCK)
        sizes = np.frombuffer(raw, "<u4", 1 + per * bits, _HEAD.size)
        ends = _HEAD.size + sizes.nbytes + np.cumsum(sizes, dtype=np.int64)
        starts = (ends - sizes).tolist()
        body = zstandard.ZstdDecompressor().decompress(raw[starts[0] : starts[0] + int(sizes[0])])
        zeros, lengths = np.frombuffer(body, "<u8", bits), np.frombuffer(body, "<u4", docs, 8 * bits)
        at, each = 8 * bits + 4 * docs, size * 8 // BLOCK + 1
        ranks = [np.frombuffer(body, "<u4", each, at + 4 * each * k) for k in range(bits)]
        spans = list(zip(starts[1:], ends[1:].tolist()))
        return cls(n, bits, [PackedPlane(raw, size, spans[per * k : per * (k + 1)]) for k in range(bits)], zeros.tolist(), ranks), lengths


class PackedPlane:
    """A plane of a file: bytes in blocks, each unpacked when first asked for."""

    def __init__(self, raw: bytes, size: int, spans: list[tuple[int, int]]):
        self.raw, self.size, self.spans = raw, size, spans
        self.blocks: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.size

    def _block(self, i: int) -> np.ndarray:
        if i not in self.blocks:
            a, b = self.spans[i]
            self.blocks[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[a:b]), np.uint8)
        return self.blocks[i]

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self._block(at // FILE_BLOCK)[at % FILE_BLOCK]
        start, stop, _ = at.indices(self.size)
        parts = [self._block(i)[max(0, start - i * FILE_BLOCK) : stop - i * FILE_BLOCK] for i in range(start // FILE_BLOCK, -(-stop // FILE_BLOCK))] if stop > start else []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def __array__(self, dtype=None, copy=None):
        """The whole plane; nothing of it is kept."""
        unpack = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(unpack(self.raw[a:b]) for a, b in self.spans), np.uint8)


SHARDS = "task int, shard int, first_id long, n_ids long, doc_ids binary, file binary"


def write_shards(docs: DataFrame, path: str, style: str = "byte_level", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """docs: doc_id, text.  The table of shard files; first_id counts the ids before it in its task."""
    end = np.array([end_id], np.uint32)
    names = [c.split()[0] for c in SHARDS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        encoder, task = shared_encoder(path, style), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        doc_ids: list[int | None] = []
        shard, done, held = 0, 0, 0

        def close():
            keys = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64())], names=["doc_id"])
            file = WaveletMatrix.build(np.concatenate(ids)).to_bytes(np.array(lengths))
            row = [task, shard, done, held, keys.serialize().to_pybytes(), file]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, types)], names=names)

        for b in batches:
            keys, at = b.column("doc_id").to_pylist(), 0
            for texts in slices_of(b.column("text")):
                got, _ = encoder.encode(texts)
                for k, doc_id in enumerate(keys[at : at + len(texts)]):
                    ids += [got.flat[got.start[k] : got.start[k + 1]], end]
                    lengths.append(int(got.start[k + 1] - got.start[k]) + 1)
                    doc_ids.append(doc_id)
                    held += lengths[-1]
                    if held >= shard_ids:
                        yield close()
                        shard, done, held = shard + 1, done + held, 0
                        ids, lengths, doc_ids = [], [], []
                at += len(texts)
        if ids:
            yield close()

    # rows of one id are dealt on by a hash of their text, so that an id that many rows have is no single task
    n = C.partitions_for(docs.sparkSession, C.planned_bytes(docs), 256 << 20)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    dealt = keyed.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")
    return C.stored(dealt.mapInArrow(run, SHARDS), "wavelet", max_records=1)


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document's ids from the files: doc_id, start, n_tokens, ids_crc32."""
    totals = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    # a row for each task of the writing stage, so a single window and a broadcast are bounded by it
    before = totals.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = shards.join(F.broadcast(before), "task").select((F.col("before") + F.col("first_id")).alias("first_id"), "doc_ids", "file")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for b in batches:
            for first, keys, file in zip(b.column("first_id").to_pylist(), b.column("doc_ids").to_pylist(), b.column("file").to_pylist()):
                matrix, lengths = WaveletMatrix.from_bytes(file)
                raw = memoryview(matrix.all().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                doc_ids = pa.ipc.read_record_batch(pa.py_buffer(keys), pa.schema([("doc_id", pa.int64())])).column(0)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + first), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, schema)


def op8_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
