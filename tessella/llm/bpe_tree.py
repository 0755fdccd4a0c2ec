"""BPE encoding and decoding; long unsplit text by tree concatenation.

Usual text is encoded word by word.  A pre-token of more than `leaf` bytes is
unsplit text: it is cut into leaves, which Spark deals out and encodes in
parallel, and neighbouring runs of ids are then joined as a tree, in rounds that
each join `FAN` runs in one group, so that one huge text is many tasks up to its
last round.  At a join a window of ids on both sides is encoded anew and grows
until its first id is the left side's and its last id the right side's; all
neighbouring ids are then a pair that BPE itself would leave apart, which makes
the sequence the encoding of the whole.

Null text counts as empty: no ids, the digests of nothing.  Repeated rows each
get their own answer, also under one id; an empty table gives no rows; a very
long text costs memory in proportion to itself in the task that reads it and in
the last round; of other columns nothing is read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _common as C
from tessella.llm._encode import PieceEncoder, slices_of

#: Bytes of a leaf, and runs that one group of a round joins.
LEAF, FAN = 4096, 16


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF, pieces: PieceEncoder | None = None):
        self.pieces = pieces or PieceEncoder(path)
        self.tok, self.leaf = self.pieces.tok, leaf
        self.token = [""] * (max(self.tok.get_vocab().values()) + 1)
        for text, i in self.tok.get_vocab().items():
            self.token[i] = text
        self._special = re.compile("(" + "|".join(map(re.escape, self.pieces.special)) + ")") if self.pieces.special else None

    def model(self, mapped: str) -> list[int]:
        """Ids of one pre-token, given as byte characters."""
        return [t.id for t in self.tok.model.tokenize(mapped)]

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        if not left or not right:
            return left + right
        while True:
            i, j = min(window, len(left)), min(window, len(right))
            new = self.model("".join(self.token[x] for x in left[-i:] + right[:j]))
            if (i == len(left) or new[0] == left[-i]) and (j == len(right) or new[-1] == right[j - 1]):
                return left[:-i] + new + right[j:]
            window *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is unsplit, byte characters) of long pre-tokens; (False, pre-tokens with spaces between them) of the others.

        All are pre-tokens of the whole text: white space looks at what comes
        after it, so a stretch cut out of the text has others.
        """
        out: list[tuple[bool, str]] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.pieces.special:
                out.append((False, part))
                continue
            usual: list[str] = []
            for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
                if len(mapped) > self.leaf:
                    out += [(False, " ".join(usual)), (True, mapped)]
                    usual = []
                else:
                    usual.append(mapped)
            out.append((False, " ".join(usual)))
        return [x for x in out if x[1]]

    def usual(self, part: str) -> list[int]:
        """Ids of a part that is no unsplit text: a special token, or pre-tokens (no byte character is a space)."""
        if part in self.pieces.special:
            return [self.tok.token_to_id(part)]
        return [i for x in part.split(" ") for i in self.model(x)]

    def leaves(self, mapped: str) -> list[str]:
        return [mapped[k : k + self.leaf] for k in range(0, len(mapped), self.leaf)]

    def encode(self, text: str) -> list[int]:
        """The same within one process."""
        out: list[int] = []
        for unsplit, part in self.parts(text):
            out += self.tree([self.model(x) for x in self.leaves(part)]) if unsplit else self.usual(part)
        return out


class Decoder:
    """decode(ids, skip_special_tokens=False), from the tokens' bytes."""

    def __init__(self, tok):
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
        raw = [b""] * (max([*tok.get_vocab(with_added_tokens=True).values()]) + 1)
        for text, i in tok.get_vocab(with_added_tokens=True).items():
            raw[i] = special[i].encode() if i in special else bytes(byte[c] for c in text)
        self.bytes = pa.array(raw, pa.binary())

    def decode(self, ids: np.ndarray, start: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each ids[start[i] : start[i + 1]]; what is no UTF-8 becomes U+FFFD."""
        found = self.bytes.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int32)
        data = memoryview(found.buffers()[2] or b"")
        return [str(data[i:j], "utf-8", "replace").encode() for i, j in zip(ends[start[:-1]].tolist(), ends[start[1:]].tolist())]


class Both:
    """Encoder, tree and decoder of a worker, over one tokenizer."""

    def __init__(self, path: str, leaf: int):
        self.encoder = PieceEncoder(path)
        self.tree = TreeEncoder(path, leaf, self.encoder)
        self._decoder: Decoder | None = None

    @property
    def decoder(self) -> Decoder:
        if self._decoder is None:
            self._decoder = Decoder(self.encoder.tok)
        return self._decoder


def _both(path: str, leaf: int = LEAF) -> Both:
    return C.kept(("tree", path, leaf), lambda: Both(path, leaf))


PARTS = "row long, doc_id long, part int, leaf int, unsplit boolean, text string, ids binary"
RUNS = "row long, doc_id long, part int, leaf int, unsplit boolean, ids binary"
ENCODED = "row long, doc_id long, ids binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def parts_of(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """docs: row, doc_id, text.  One pass: a row with the ids of each usual text (part -1),
    and of any other its parts in order, leaves of unsplit ones still as text."""

    def run(batches):
        both = _both(path, leaf)
        for b in batches:
            rows_, keys, at = b.column("row").to_pylist(), b.column("doc_id").to_pylist(), 0
            for texts in slices_of(b.column("text")):
                ids, long = both.encoder.encode(texts, leaf)
                out = []
                for k, is_long in enumerate(long.tolist()):
                    row, doc_id = rows_[at + k], keys[at + k]
                    if not is_long:
                        out.append((row, doc_id, -1, 0, False, None, ids.flat[ids.start[k] : ids.start[k + 1]].astype("<u4").tobytes()))
                        continue
                    for j, (unsplit, part) in enumerate(both.tree.parts(texts[k].as_py())):
                        if unsplit:
                            out += [(row, doc_id, j, i, True, x, None) for i, x in enumerate(both.tree.leaves(part))]
                        else:
                            out.append((row, doc_id, j, 0, False, None, _packed(both.tree.usual(part))))
                at += len(texts)
                yield _batch(out, PARTS)

    return docs.select("row", "doc_id", "text").mapInArrow(run, PARTS)


def _joined_leaves(leaves: DataFrame, path: str, leaf: int, fan: int) -> DataFrame:
    """RUNS of one row for each unsplit part, by rounds of joins."""

    def first(batches):
        tree = _both(path, leaf).tree
        for b in batches:
            ids = [_packed(tree.model(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.binary())], names=[*b.schema.names[:5], "ids"])

    def join(table: pa.Table) -> pa.Table:
        tree, rows = _both(path, leaf).tree, table.sort_by([("leaf", "ascending")]).to_pylist()
        ids = tree.tree([_unpacked(r["ids"]) for r in rows])
        return pa.Table.from_batches([_batch([(rows[0]["row"], rows[0]["doc_id"], rows[0]["part"], rows[0]["leaf"] // fan, True, _packed(ids))], RUNS)])

    most = leaves.agg(F.max("leaf")).first()[0]
    out = leaves.repartition("row", "part", "leaf").select("row", "doc_id", "part", "leaf", "unsplit", "text").mapInArrow(first, RUNS)
    while most:
        out = out.withColumn("_group", F.expr(f"leaf div {fan}")).groupBy("row", "part", "_group").applyInArrow(join, RUNS)
        most //= fan
    return out


def encode(docs: DataFrame, path: str, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """docs: doc_id, text.  row (one for each document), doc_id and ids, little-endian unsigned 32-bit."""
    parts = C.stored(parts_of(docs.withColumn("row", F.monotonically_increasing_id()), path, leaf), "bpe-parts")
    done, cut = parts.where("part < 0").select("row", "doc_id", "ids"), parts.where("part >= 0")
    if cut.isEmpty():
        return done
    others, leaves = cut.where("not unsplit").drop("text"), cut.where("unsplit")
    runs = others if leaves.isEmpty() else others.unionByName(C.stored(_joined_leaves(leaves, path, leaf, fan), "bpe-runs"))

    def whole(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending")]).to_pylist()
        return pa.Table.from_batches([_batch([(rows[0]["row"], rows[0]["doc_id"], b"".join(r["ids"] for r in rows))], ENCODED)])

    return done.unionByName(runs.groupBy("row").applyInArrow(whole, ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded: row, doc_id, ids.  The same with the decoded text's UTF-8."""

    def run(batches):
        decoder = _both(path).decoder
        for b in batches:
            for ids, texts, part in _decoded(b, decoder):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.select("row", "doc_id", "ids").mapInArrow(run, f"{ENCODED}, decoded binary")


def _decoded(batch: pa.RecordBatch, decoder: Decoder, rows: int = 500):
    """For slices of a batch: the ids of each row as bytes, the decoded texts, the slice."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        ids = part.column("ids").to_pylist()
        start = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        yield ids, decoder.decode(np.frombuffer(b"".join(ids), "<u4"), start), part


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """encoded: row, doc_id, ids.  doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches):
        decoder = _both(path).decoder
        for b in batches:
            for ids, texts, part in _decoded(b, decoder):
                yield _batch(list(zip(part.column("doc_id").to_pylist(), [len(x) // 4 for x in ids], map(sha, ids), map(sha, texts))), schema)

    return encoded.select("row", "doc_id", "ids").mapInArrow(run, schema)


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(C.read(spark, sf_dir, "documents"), path), path)
