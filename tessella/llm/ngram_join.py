"""N-gram Jaccard join by vertical partitioning, up to the groups of linked documents.

A document's set holds the 48-bit hashes of its distinct word shingles; equal
sets are one node.  The global order of the n-grams puts common n-grams last
(ascending frequency, then hash) and is cut into fragments:

1. The first part of each set (its zone) is counted fragment by fragment; n-grams
   found in more than `common` sets are the common ones.  Their number has a
   bound: of more than `max_common`, the most frequent are taken, which changes
   what candidates cost and not what is found.
2. With p = n - ceil(t n) + 1 and l = p // 2, two sets of the wanted similarity
   share l n-grams (the smaller l) among the first p + l - 1 of the order
   (prefix).  The prefixes meet fragment by fragment.  A short posting list
   counts its pairs, and a pair whose counts sum to less than l over all
   fragments is no candidate; a long list, which only near copies of a large
   family fill, gives each member's edge to one hub.
3. Candidate pairs are dealt out by the component they lie in, large components
   in tiles of two blocks, and their partial overlaps are counted fragment by
   fragment and summed; a pair is dropped as soon as the rest cannot suffice.
4. Members of a family of many blocks are first held against one of them, its
   hub.  Those that it is linked with are connected; the rest meet all members, in
   tiles of two bounded blocks (a small family is one tile): partial overlaps of
   all pairs of a tile are products of incidence matrices, summed over the
   fragments.  No pair becomes a row; a tile returns each node's edge to the
   smallest node it is linked with there.
5. An n-gram that stands in more than `hot` zones has no posting list: each of its
   sets gets an edge to a label of the n-gram itself, wherever it is met.

So a link is never lost: every pair that can reach the threshold is counted
exactly.  (Equality of hashes stands for equality of shingles and of sets: 48
bits within a pair, 64 bits for sets.)

A null text, or one without words, has the empty set and no link; with fewer
words than a shingle has, the words as a whole are the one shingle.  Repeated
rows and ids are linked by their equal sets; a null id is never a smallest id
beside another one; an empty table gives no rows; a very long text is one set, in
memory in proportion to its words; of other columns nothing is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _common as C
from tessella.llm._graph import connected_components

COMMON, MAX_COMMON, SHORT_LIST, BLOCK_NODES, BLOCK_BYTES, FRAGMENTS, BITS = 8, 1 << 20, 64, 1024, 16 << 20, 4, 48
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


#: Rows of sets that are unpacked at a time, and pairs that are held at a time.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 2000, 250_000
#: Zones that an n-gram may stand in and still have a posting list.
HOT = 50_000
#: Sets that a task knows as seen; beyond them an equal set may give its tokens again, which costs bytes and changes nothing.
SEEN_SETS = 500_000
#: Rows of 24 bytes at most that are sent to every task instead of being shuffled.
MOST_SENT = 2_000_000


def _slices(batches):
    """Batches of few rows; word hashes that a worker may still keep are let go first."""
    C.kept("join", object)
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(k, ROWS_AT_ONCE)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = out
        return out


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), n) >> (64 - BITS)], np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = n - width + 1
    h = a[:m] * _MIX[0]
    for j in range(1, width):
        h ^= h >> np.uint64(29)
        h += a[j : j + m]
        h *= _MIX[j % len(_MIX)]
        h ^= h >> np.uint64(32)
    return np.unique(h >> np.uint64(64 - BITS))


def packed(tokens: np.ndarray) -> bytes:
    """Six bytes a token."""
    return (tokens >> np.uint64(16)).astype("<u4").tobytes() + (tokens & np.uint64(0xFFFF)).astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64)


SETS = "doc_id long, n long, node long, tokens binary"


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document; equal sets within a task give their tokens once."""

    def run(batches):
        hashes, seen = C.kept("words", WordHashes), set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                nodes, sizes, blobs = [], [], []
                for text in C.column_bytes(some, "text"):
                    tokens = shingles(text.lower().split(), width, hashes)
                    node = blob = None
                    if len(tokens):
                        node = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
                        if node not in seen:
                            if len(seen) < SEEN_SETS:
                                seen.add(node)
                            blob = packed(tokens)
                    nodes.append(node)
                    sizes.append(len(tokens))
                    blobs.append(blob)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "node", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _prefix(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _shared(n, percent: int):
    """The n-grams that must be shared within the prefix; of a number or an array of them."""
    return np.maximum(1, _prefix(n, percent) // 2)


def _by_fragment(tokens: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The non-empty fragments of sorted tokens."""
    edges = np.searchsorted(tokens, (np.arange(buckets + 1, dtype=np.float64) * (2.0**BITS / buckets)).astype(np.uint64))
    return [(k, slice(edges[k], edges[k + 1])) for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]


def common_tokens(sets: DataFrame, percent: int, buckets: int, common: int, max_common: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that stand in the zones of more than `common` sets, sorted, and their counts."""

    def zones(batches):
        for b in _slices(batches):
            parts = [unpacked(x) for x in b.column("tokens").to_pylist()]
            if parts:
                tokens, counts = np.unique(np.concatenate([t[: 2 * _prefix(len(t), percent) + 2] for t in parts]), return_counts=True)
                cut = _by_fragment(tokens, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([packed(tokens[s]) for _, s in cut], pa.binary()), pa.array([counts[s].astype("<u4").tobytes() for _, s in cut], pa.binary())], names=["bucket", "tokens", "counts"])

    def count(batches):
        tokens, counts = [], []
        for b in batches:
            tokens += [unpacked(x) for x in b.column("tokens").to_pylist()]
            counts += [np.frombuffer(x, "<u4") for x in b.column("counts").to_pylist()]
        if tokens:
            t, c = np.concatenate(tokens), np.concatenate(counts)
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            sums = np.add.reduceat(c.astype(np.int64), starts)
            many = sums > common
            yield pa.RecordBatch.from_arrays([pa.array(t[starts][many].astype(np.int64)), pa.array(sums[many])], names=["token", "n"])

    zone = sets.where("tokens is not null").select("tokens").mapInArrow(zones, "bucket int, tokens binary, counts binary")
    found = C.stored(zone.repartition(buckets, "bucket").mapInArrow(count, "token long, n long"), "common")
    if found.count() > max_common:
        found = found.orderBy(F.desc("n"), "token").limit(max_common)
    got = found.toArrow()  # max_common rows at most
    tokens, n = got.column("token").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def candidates(sets: DataFrame, percent: int, buckets: int, known: tuple[np.ndarray, np.ndarray], short_list: int, hot: int = HOT) -> DataFrame:
    """star, a, b: pairs of nodes (star false), and edges from members of long lists to their hubs.

    A pair with an n-gram in a long list is covered by the list's family; any
    other has all that it shares in short lists, so their counts are complete.
    """
    told = sets.sparkSession.sparkContext.broadcast(known)

    def prefixes(batches):
        common, count = told.value
        for b in _slices(batches):
            tokens, nodes, sizes = [], [], []
            for raw, node in zip(b.column("tokens").to_pylist(), b.column("node").to_pylist()):
                t = unpacked(raw)
                p = _prefix(len(t), percent) + int(_shared(len(t), percent)) - 1
                at = np.searchsorted(common, t)
                at[at == len(common)] = 0
                is_common = common[at] == t if len(common) else np.zeros(len(t), bool)
                take = t[~is_common][:p]
                if len(take) < p:
                    rest = t[is_common]
                    take = np.concatenate((take, rest[np.lexsort((rest, count[at[is_common]]))[: p - len(take)]]))
                tokens.append(take)
                nodes.append(np.full(len(take), node, np.int64))
                sizes.append(np.full(len(take), len(t), np.uint32))
            if tokens:
                t, n, s = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
                many = np.isin(t, common[count > hot])
                if many.any():  # dealt by node, to buckets beyond the others
                    share = buckets + n[many] % buckets
                    for k in np.unique(share).tolist():
                        of = np.flatnonzero(many)[share == k]
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x], pa.binary()) for x in (packed(t[of]), n[of].tobytes(), s[of].tobytes())]], names=["bucket", "tokens", "nodes", "sizes"])
                    t, n, s = t[~many], n[~many], s[~many]
                order = np.argsort(t, kind="stable")
                t, n, s = t[order], n[order], s[order]
                cut = _by_fragment(t, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([packed(t[c]) for _, c in cut], pa.binary()), pa.array([n[c].tobytes() for _, c in cut], pa.binary()), pa.array([s[c].tobytes() for _, c in cut], pa.binary())], names=["bucket", "tokens", "nodes", "sizes"])

    names = ["star", "a", "b", "least", "c"]

    def counted(a, b, least, c):
        """Equal pairs summed."""
        order = np.lexsort((b, a))
        a, b, least, c = a[order], b[order], least[order], c[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        return a[starts], b[starts], least[starts], np.add.reduceat(c, starts) if len(a) else c

    def partial(held):
        """Pairs with their counts so far; counts are summed over all such parts later."""
        a, b, least, c = counted(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b), pa.array(least), pa.array(c)], names=names)

    def meet(batches):
        common, count = told.value
        parts = [(unpacked(x), np.frombuffer(y, np.int64), np.frombuffer(z, np.uint32)) for b in _slices(batches) for x, y, z in zip(b.column("tokens").to_pylist(), b.column("nodes").to_pylist(), b.column("sizes").to_pylist())]
        if not parts:
            return
        t, n, s = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((n, t))
        t, n, s = t[order], n[order], s[order].astype(np.int64)
        new = np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1])]
        t, n, s = t[new], n[new], s[new]
        many = np.isin(t, common[count > hot])
        if many.any():  # the n-gram's label: 48 bits below zero
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(many.sum(), bool)), pa.array(-1 - t[many].astype(np.int64)), pa.array(n[many]), *[pa.array(np.zeros(many.sum(), np.int64))] * 2], names=names)
            t, n, s = t[~many], n[~many], s[~many]
        if not len(t):
            return
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[starts, len(t)])
        seen: set[bytes] = set()
        held: list[tuple] = []
        for m in np.unique(length[length > 1]).tolist():
            first = starts[length == m]
            if m > short_list:
                for k in first.tolist():
                    members = n[k : k + m]
                    key = xxhash.xxh3_128_digest(members.tobytes())
                    if key not in seen:  # a family's n-grams mostly have the same list
                        seen.add(key)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m - 1, bool)), pa.array(np.full(m - 1, members[0])), pa.array(members[1:]), pa.array(np.zeros(m - 1, np.int64)), pa.array(np.zeros(m - 1, np.int64))], names=names)
                continue
            i, j = np.triu_indices(m, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for at in range(0, len(first), step):
                rows = first[at : at + step, None]
                x, y = (rows + i).ravel(), (rows + j).ravel()
                fits = 100 * np.minimum(s[x], s[y]) >= percent * np.maximum(s[x], s[y])
                held.append(counted(n[x[fits]], n[y[fits]], np.minimum(_shared(s[x[fits]], percent), _shared(s[y[fits]], percent)), np.ones(int(fits.sum()), np.int64)))
                if sum(len(h[0]) for h in held) > 4 * PAIRS_AT_ONCE:
                    yield partial(held)
                    held = []
        if held:
            yield partial(held)

    posted = sets.where("tokens is not null").select("node", "tokens").mapInArrow(prefixes, "bucket int, tokens binary, nodes binary, sizes binary")
    met = posted.repartition(2 * buckets, "bucket").mapInArrow(meet, "star boolean, a long, b long, least long, c long")
    summed = met.groupBy("star", "a", "b").agg(F.max("least").alias("least"), F.sum("c").alias("c"))
    return summed.where("star or c >= least").select("star", "a", "b")


def _reaches(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int, fragments: int = FRAGMENTS) -> bool:
    """Whether the similarity suffices, by partial overlaps; ends when what is left cannot suffice."""
    na, nb = len(a), len(b)
    edges = (np.arange(1, fragments, dtype=np.uint64) << np.uint64(BITS)) // np.uint64(fragments)
    ea, eb = (np.r_[0, np.searchsorted(x, edges), len(x)] for x in (a, b))
    rest = int(np.minimum(np.diff(ea), np.diff(eb)).sum())
    got = 0
    for k in range(fragments):
        rest -= min(ea[k + 1] - ea[k], eb[k + 1] - eb[k])
        got += len(np.intersect1d(a[ea[k] : ea[k + 1]], b[eb[k] : eb[k + 1]], assume_unique=True))
        if not _reaches(got + rest, na, nb, percent):
            return False
    return True


def overlaps(a: list[np.ndarray], b: list[np.ndarray], fragments: int = FRAGMENTS, columns: int = 4096) -> np.ndarray:
    """Overlap of every a with every b: incidence products of each fragment, summed."""
    out = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2**24: exact
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(t) for t in x])) for x in (a, b)]
    for k in range(fragments):
        low, high = (np.uint64((j << BITS) // fragments) for j in (k, k + 1))
        (ta, ra), (tb, rb) = ((t[m], r[m]) for t, r in sides for m in [(t >= low) & (t < high)])
        both = np.intersect1d(ta, tb)
        for at in range(0, len(both), columns):
            some = both[at : at + columns]
            grids = []
            for t, r, rows in ((ta, ra, len(a)), (tb, rb, len(b))):
                c = np.searchsorted(some, t)
                c[c == len(some)] = 0
                hit = some[c] == t
                grid = np.zeros((rows, len(some)), np.float32)
                grid[r[hit], c[hit]] = 1
                grids.append(grid)
            out += grids[0] @ grids[1].T
    return out


def _least_linked(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix, the smallest label of what they are connected with; labels: rows first, then columns."""
    n, m = linked.shape
    rows, cols = np.arange(n), n + np.arange(m)
    while True:
        r = np.minimum(rows, np.where(linked, cols, n + m).min(1, initial=n + m))
        c = np.minimum(cols, np.where(linked, r[:, None], n + m).min(0, initial=n + m))
        if (r == rows).all() and (c == cols).all():
            return rows, cols
        rows, cols = r, c


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(sets: DataFrame, percent: int, common: int = COMMON, max_common: int = MAX_COMMON, short_list: int = SHORT_LIST, block_nodes: int = BLOCK_NODES, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """a, b: enough of the links between nodes to connect all that are linked."""
    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = C.partitions_for(spark, 8 * total)
    known = common_tokens(sets, percent, buckets, common, max_common)
    found = C.stored(candidates(sets, percent, buckets, known, short_list, hot), "candidates")
    stars, pairs = found.where("star").select("a", "b"), found.where("not star").select("a", "b")

    # one row of tokens for each node that has a candidate
    involved = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    holders = sets.where("tokens is not null").join(involved, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("h"), F.first("n").alias("n"))
    holders = C.stored(holders.select("node", F.col("h.doc_id").alias("doc_id"), "n"), "holders")
    few = holders.count() <= MOST_SENT
    narrow = F.broadcast(holders.select("node", "doc_id")) if few else holders.select("node", "doc_id")
    s, h = sets.where("tokens is not null").select("node", "doc_id", "tokens").alias("s"), narrow.alias("h")
    held = s.join(h, (F.col("s.node") == F.col("h.node")) & F.col("s.doc_id").eqNullSafe(F.col("h.doc_id")), "left_semi")

    def blocked(groups: DataFrame) -> DataFrame:
        """groups: node, component.  node, group, block, blocks: large groups are cut into blocks of bounded rows and bytes."""
        sized = groups.join(holders.select("node", "n"), "node")
        size = sized.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * 6).alias("bytes"))
        blocks = F.ceil(F.greatest(F.col("k") / block_nodes, F.col("bytes") / block_bytes)).cast("int")
        cut = C.spread_join(sized, size.select("component", blocks.alias("blocks")), "component", "node")
        return cut.select("node", F.col("component").alias("group"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")

    def tiles_of(edges: DataFrame) -> DataFrame:
        return blocked(connected_components(edges))

    # pairs, in tiles of their component
    placed = C.stored(tiles_of(pairs), "tiles")
    a, b = placed.toDF("a", "group", "i", "_1").drop("_1"), placed.select(F.col("node").alias("b"), F.col("block").alias("j"))
    tile = F.xxhash64("group", F.least("i", "j"), F.greatest("i", "j"))
    bins = C.partitions_for(spark, 6 * (holders.agg(F.sum("n")).first()[0] or 0), block_bytes)
    dealt = C.stored(pairs.join(a, "a").join(b, "b").select(F.pmod(tile, F.lit(bins)).cast("int").alias("cell"), "a", "b"), "pairs")
    needed = dealt.select(F.col("cell").alias("bin"), F.col("a").alias("node")).union(dealt.select("cell", "b")).distinct()
    needed = F.broadcast(needed) if few and needed.count() <= MOST_SENT else needed
    sent = held.join(needed, "node").select("bin", "node", "tokens")

    def verify(nodes: pa.Table, told: pa.Table) -> pa.Table:
        tokens = dict(zip(nodes.column("node").to_pylist(), map(unpacked, nodes.column("tokens").to_pylist())))
        ok = [(x, y) for x, y in zip(told.column("a").to_pylist(), told.column("b").to_pylist()) if overlap_reaches(tokens[x], tokens[y], percent)]
        return pa.Table.from_arrays([pa.array([x for x, _ in ok], pa.int64()), pa.array([y for _, y in ok], pa.int64())], schema=LINKS)

    verified = sent.groupBy("bin").cogroup(dealt.groupBy("cell")).applyInArrow(verify, "a long, b long")
    if stars.isEmpty():
        return verified

    family = C.stored(tiles_of(stars), "families")
    large, small = family.where("blocks > 1"), family.where("blocks = 1")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = small.select("node", F.xxhash64("group").alias("tile"), F.lit(True).alias("left"), F.lit(True).alias("same"))
    if not large.isEmpty():
        # a large family's members meet one of them, its hub, first: block by block, so in proportion to their number
        hubs = large.groupBy("group").agg(F.min_by("node", F.xxhash64(F.lit("hub"), "node")).alias("node"), F.max("blocks").alias("blocks"))
        sent_hubs = held.join(hubs, "node").select("group", "node", "tokens", every("blocks")).toDF("of", "hub", "sent", "part")
        members = held.join(large, "node").select("group", "block", "node", "tokens")

        def to_hub(nodes: pa.Table, hub: pa.Table) -> pa.Table:
            at = unpacked(hub.column("sent")[0].as_py())
            near = [x for x, t in zip(nodes.column("node").to_pylist(), nodes.column("tokens").to_pylist()) if overlap_reaches(unpacked(t), at, percent)]
            return pa.Table.from_arrays([pa.array(near, pa.int64()), pa.array([hub.column("hub")[0].as_py()] * len(near), pa.int64())], schema=LINKS)

        linked = C.stored(members.groupBy("group", "block").cogroup(sent_hubs.groupBy("of", "part")).applyInArrow(to_hub, "a long, b long"), "hubs")
        verified = verified.union(linked)
        # those that are not linked with it meet all members; the others are connected among themselves already
        rest = C.stored(blocked(large.join(linked.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("group").alias("component"))), "rest")
        counts = rest.groupBy("group").agg(F.max("blocks").alias("rests"))
        tile = F.xxhash64("group", "rest", "block").alias("tile")
        left = rest.select("node", "group", F.col("block").alias("rest")).join(large.groupBy("group").agg(F.max("blocks").alias("all")), "group").select("node", "group", "rest", every("all").alias("block"))
        right = large.join(counts, "group").select("node", "group", "block", every("rests").alias("rest"))
        for side, is_left in ((left, True), (right, False)):
            spread = spread.unionByName(side.select("node", tile, F.lit(is_left).alias("left"), F.lit(False).alias("same")))
    spread = C.stored(spread, "spread")
    sent_spread = F.broadcast(spread) if spread.count() <= MOST_SENT else spread

    def compare(table: pa.Table) -> pa.Table:
        left = np.array(table.column("left").to_pylist(), bool)
        same = bool(table.column("same")[0].as_py())
        nodes = table.column("node").to_numpy()
        tokens = [unpacked(x) for x in table.column("tokens").to_pylist()]
        rows, cols = (np.arange(len(nodes)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if not len(rows) or not len(cols):
            return LINKS.empty_table()
        a, b = [tokens[i] for i in rows], [tokens[i] for i in cols]
        na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
        linked = _reaches(overlaps(a, b).astype(np.int64), na, nb, percent)
        r, c = _least_linked(linked)
        names = np.concatenate((nodes[rows], nodes[cols]))
        return pa.Table.from_arrays([pa.array(names), pa.array(names[np.concatenate((r, c))])], schema=LINKS)

    return verified.union(held.join(sent_spread, "node").select("tile", "left", "same", "node", "tokens").groupBy("tile").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text.  A row for each document: doc_id, n_shingles, component_id."""
    sets = C.stored(sets_of(docs, width), "sets")
    groups = connected_components(links(sets, percent))
    least = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    whole = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = C.spread_join(named, whole, "component", "node").select("node", "component_id")
    return sets.select("doc_id", "n", "node").join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"), width=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other
), m AS (SELECT node, min(other) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""
