"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers.  An index block holds, for each dimension and
each coarse level of its values, a posting segment: the rows at that level.  The
segments of a query are processed by descending quantised impact (query value
times level); accumulators hold what has been added so far and how many
dimensions of a row are done.  At checkpoints the rows of the highest upper
bounds are scored exactly; processing stops only when every other row's upper
bound is below the k-th exact score, and all rows that could still belong are
scored exactly.  If no proof comes, all rows are.

Queries are taken many at a time: what the segments done by a checkpoint add to
each row, and what the others may add at most, is one product with the segments'
rows as a 0/1 matrix, in whole numbers that 32-bit floats hold exactly.  Where
they do not, the segments' rows are added one query at a time.

Blocks have a bounded number of rows; every block of queries meets every block
of rows, one pair of blocks at a time, and only k rows of each leave it.

Components are 64-bit integers.  Whether scores can leave what the index's sums or
64-bit floats hold exactly is told by each block's largest component; such a block
has no proof and all its rows are scored in whole numbers.

A vector that is null, empty or holds null or non-finite components takes no
part; vectors of other lengths than the query's are no candidates.  A component or
a score beyond 64 bits is an error.  Repeated ids are rows of their own; equal
scores go to the smaller id; without queries or candidates, as on an empty table,
there are no rows; of other columns nothing is read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import _common as C
from tessella.operators import retrieval as R

SCALE, LEVEL_BITS, BLOCK_ROWS, QUERY_ROWS = 256, 5, 16384, 512
#: So many queries share a product, with segments of at most so many bytes at a time.
TOGETHER, SEGMENT_BYTES = 128, 64 << 20
#: Scores below half of this are kept in one number with the count of dimensions done.
_DONE = 1 << 44


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")
    far = F.exists(vector, lambda x: F.abs(F.lit(scale) * x.cast("double")) >= F.lit(2.0**63))
    return F.when(ok & far, F.raise_error(F.lit("a component beyond 64 bits")).cast("array<bigint>")).when(ok, F.transform(vector, whole))


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


class ImpactIndex:
    def __init__(self, ids: np.ndarray, values: np.ndarray, level_bits: int = LEVEL_BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        self.largest = _largest(self.values)
        self.step = 1 << level_bits
        self.level = self.values >> level_bits
        self.check, self._slabs = 1, None

    @cached_property
    def exact(self) -> np.ndarray:
        return self.values.astype(np.float64)  # whole numbers below 2**53: exact

    @cached_property
    def small(self) -> np.ndarray:
        return self.values.astype(np.float32)  # only where all sums stay below 2**24

    @cached_property
    def levels(self) -> list[np.ndarray]:
        return [np.unique(self.level[:, d]) for d in range(self.values.shape[1])]

    @cached_property
    def rows(self) -> list[np.ndarray]:
        return [np.argsort(self.level[:, d], kind="stable") for d in range(self.values.shape[1])]

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        return [np.append(np.searchsorted(self.level[rows, d], found), len(rows)) for d, (rows, found) in enumerate(zip(self.rows, self.levels))]

    def _segments(self):
        """(from, to, matrix): which rows stand in each of these segments, as 0 and 1; kept if they are few."""
        if self._slabs is not None:
            yield from self._slabs
            return
        at, slab, start, n = 0, [], 0, max(1, len(self.ids))
        most = max(1, SEGMENT_BYTES // (4 * n))
        for d, found in enumerate(self.levels):
            for h in found:
                slab.append(self.level[:, d] == h)
                at += 1
                if len(slab) == most:
                    yield start, at, np.array(slab, np.float32)
                    slab, start = [], at
        if slab:
            last = (start, at, np.array(slab, np.float32))
            if start == 0:
                self._slabs = [last]
            yield last

    def search_all(self, queries: np.ndarray, k: int, owns: np.ndarray, checks: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores: of each query the k best rows whose id is not its own."""
        out = []
        for i in range(0, len(queries), TOGETHER):
            some, own = queries[i : i + TOGETHER], owns[i : i + TOGETHER]
            if len(self.ids) and (self.largest + self.step + 1) * (_largest(some) + 1) * max(1, some.shape[1]) < 1 << 24:
                at, place, score = self._together(some, k, own, checks)
                out.append((at + i, self.ids[place], score))
            else:
                for j, (q, o) in enumerate(zip(some, own)):
                    ids, score = self.search(q, k, o, checks)
                    out.append((np.full(len(ids), i + j), ids, score))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _together(self, queries: np.ndarray, k: int, owns: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, q32 = len(self.ids), queries.astype(np.float32)
        dim = np.repeat(np.arange(len(self.levels)), [len(h) for h in self.levels])
        height = np.concatenate(self.levels) * self.step
        impacts = queries[:, dim] * height
        ordered = -np.sort(np.where(queries[:, dim] != 0, -impacts, np.iinfo(np.int64).max), axis=1)  # segments of dimensions without weight last
        n_live = (queries[:, dim] != 0).sum(1)
        top = np.maximum.reduceat(impacts, np.searchsorted(dim, np.arange(len(self.levels))), axis=1)[:, dim]
        slack = (np.maximum(queries, 0) * (self.step - 1)).sum(1)
        left, right = np.searchsorted(self.ids, owns, "left"), np.searchsorted(self.ids, owns, "right")
        open_, out, proofs, check = np.arange(len(queries)), [], np.zeros(checks + 2, np.int64), self.check
        while len(open_):
            ended = check > checks
            some = impacts[open_]
            if ended:
                parts = some
            else:  # segments above the next impact are done; the others add at most that
                following = ordered[open_, np.minimum(n_live[open_] * check // (checks + 1), len(dim) - 1)][:, None]
                following = np.where(n_live[open_][:, None] > 0, following, 0)
                parts = np.where(some > following, some, np.minimum(top[open_], following))
                parts[queries[open_][:, dim] == 0] = 0
            bound, parts = np.zeros((len(open_), n), np.float32), parts.astype(np.float32)
            for a, b, members in self._segments():
                bound += parts[:, a:b] @ members
            for x, i in zip(bound, open_):
                x[left[i] : right[i]] = -np.inf
            likely = np.argpartition(bound, max(0, n - 4 * k - 1), axis=1)[:, max(0, n - 4 * k - 1) :]
            exact = np.einsum("ird,id->ir", self.small[likely], q32[open_])
            exact[np.isneginf(np.take_along_axis(bound, likely, 1))] = -np.inf
            kth = np.partition(exact, -k, axis=1)[:, -k] if exact.shape[1] >= k else np.full(len(open_), -np.inf, np.float32)
            members = (bound >= (kth.astype(np.float64) - slack[open_])[:, None]) & (bound > -np.inf)
            proved = np.isfinite(kth) & (members.sum(1) <= max(16 * k, n // 2)) | ended
            proofs[check] += proved.sum()
            if proved.any():
                # the product of all costs less than picking out rows, unless these are few
                members, which = members[proved], open_[proved]
                if members.sum() * 32 > members.size:
                    score = q32[which] @ self.small.T
                    score[~members] = -np.inf
                    least = R._reached(score, k) if n > k else np.full(len(which), -np.inf)
                    row, place = np.nonzero(members & (score >= least[:, None]))
                    score = score[row, place]
                else:
                    row, place = np.nonzero(members)
                    score = np.einsum("id,id->i", self.small[place], q32[which[row]])
                row, place, score, _ = R._best_of(row, place, score.astype(np.int64), k)
                out.append((which[row], place, score))
            open_, check = open_[~proved], check + 1
        self.check = int(proofs.argmax())  # where most proofs came is where the next queries begin
        return tuple(np.concatenate(c) for c in zip(*out))

    def _exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q = query.astype(np.float64)
        if len(rows) * 8 > len(self.ids):  # picking out that many rows costs more than the product of all
            return (self.exact @ q)[rows].astype(np.int64)
        return (self.exact[rows] @ q).astype(np.int64)

    def _best(self, query: np.ndarray, rows: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        scores = self._exact(query, rows)
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def _in_whole_numbers(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows, in integers of any size."""
        rows = np.flatnonzero(self.ids != own)
        scores = self.values[rows].astype(object) @ query.astype(object) if len(rows) else np.zeros(0, object)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return self.ids[rows[order]], np.array([scores[i] for i in order], object).astype(np.int64)

    def search(self, query: np.ndarray, k: int, own: int, checks: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not `own`."""
        n = len(self.ids)
        reach = (self.largest + self.step + 1) * (_largest(query) + 1) * max(1, len(query))
        if reach >= _DONE >> 2:
            return self._in_whole_numbers(query, k, own)
        segments = [(int(q) * int(h) * self.step, d, j) for d, q in enumerate(query) if q for j, h in enumerate(self.levels[d])]
        segments.sort(key=lambda s: -s[0])
        # a row's true product in a dimension is its impact plus a rest of at most `slack`
        slack = np.maximum(query, 0) * (self.step - 1)
        top = np.array([max((int(q) * int(h) * self.step for h in hs), default=0) if q else 0 for q, hs in zip(query, self.levels)], np.int64)
        live = query != 0  # the other dimensions add nothing, also when the impact is negative
        both = np.zeros(n, np.int64)  # dimensions done, times _DONE, plus the score
        marks = {len(segments) * c // (checks + 1) for c in range(1, checks + 1)}
        everything = np.arange(n)
        for at, (impact, d, j) in enumerate(segments):
            if at in marks:
                # rows of a dimension not yet done have at most `impact` there
                score = ((both + _DONE // 2) & (_DONE - 1)) - _DONE // 2
                done = (both - score) // _DONE
                bound = score + np.minimum(top, impact)[live].sum() - np.int64(impact) * done + slack.sum()
                likely = np.argpartition(-bound, min(n - 1, 4 * k))[: 4 * k + 1]
                _, exact = self._best(query, likely, k, own)
                if len(exact) == k:
                    members = np.flatnonzero(bound >= exact[-1])
                    if len(members) <= max(16 * k, n // 2):
                        rows, scores = self._best(query, members, k, own)
                        return self.ids[rows], scores
            rows = self.rows[d][self.cuts[d][j] : self.cuts[d][j + 1]]
            both[rows] += impact + _DONE
        bound = ((both + _DONE // 2) & (_DONE - 1)) - _DONE // 2 + slack.sum()
        likely = np.argpartition(-bound, min(n - 1, 4 * k))[: 4 * k + 1]
        _, exact = self._best(query, likely, k, own)
        members = np.flatnonzero(bound >= exact[-1]) if len(exact) == k else everything
        rows, scores = self._best(query, members, k, own)
        return self.ids[rows], scores


def _blocks(vectors: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """vectors: id, v (array<long>).  A row for each block and vector length: packed ids and values."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy().astype("<i8")
        return pa.table({name: pa.array([table.column(name)[0].as_py()], pa.int32()), "size": pa.array([table.column("size")[0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "flat": pa.array([flat.tobytes()], pa.binary())})

    keyed = vectors.select(F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n_blocks)).cast("int").alias(name), F.size("v").alias("size"), "id", "v")
    return keyed.groupBy(name, "size").applyInArrow(pack, f"{name} int, size int, ids binary, flat binary")


def top_k(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Both: id, v (array<long>, null takes no part).  query_id, rank, vec_id, score."""
    queries, rows = queries.where("v is not null"), rows.where("v is not null")
    n_rows, n_queries = rows.count(), queries.count()
    n_blocks = max(1, -(-n_rows // block_rows))
    blocks = _blocks(rows, n_blocks, "block")
    n_parts = max(1, -(-n_queries // query_rows))
    # few blocks are dealt out more than once, so that parts of the queries meet them in other tasks
    copies = max(1, min(n_parts, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // n_blocks)))
    blocks = blocks.select("block", "size", "ids", "flat", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    asked = _blocks(queries, n_parts, "part").select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "size", F.pmod(F.xxhash64("part"), F.lit(copies)).cast("int").alias("copy"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    schema = "query_id long, vec_id long, score long"

    def run(batches):
        last, index = None, None
        for b in batches:
            for (r,) in (b.slice(i, 1).to_pylist() for i in range(len(b))):  # each row holds a block of rows and one of queries
                if last != (r["block"], r["size"], r["ids"]):
                    last = (r["block"], r["size"], r["ids"])
                    index = ImpactIndex(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["flat"], "<i8").reshape(-1, r["size"]))
                asked_ids = np.frombuffer(r["q_ids"], "<i8")
                at, ids, scores = index.search_all(np.frombuffer(r["q_flat"], "<i8").reshape(-1, r["size"]), k, asked_ids)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[at]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = blocks.join(asked, ["block", "size", "copy"]).mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
