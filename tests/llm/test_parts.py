"""The operators' parts: families of near copies, wavelet files, tree encoding, packing, the pipeline."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import _encode, bpe_tree, fingerprint, language_id, license_scan, ngram_join, packing, secret_scan, sharding, topk, wavelet
from tessella.llm._graph import connected_components
from test_contracts import brute_components

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def family(seed, n, words=120, edits=6):
    rnd = random.Random(seed)
    base = [f"w{seed}x{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short_list,block,hot", [(64, 1024, 50_000), (4, 16, 50_000), (2, 7, 8)])
def test_families(spark, short_list, block, hot):
    shared = " ".join(f"passage{i}" for i in range(60))
    texts = family(1, 70) + family(2, 40, edits=12) + family(3, 5) + [f"{shared} {t}" for t in family(4, 3, 200)] + [shared + " " + " ".join(f"q{i}z{j}" for j in range(150)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = ngram_join.C.stored(ngram_join.sets_of(docs, 5), "sets")
    groups = connected_components(ngram_join.links(sets, 80, common=6, short_list=short_list, block_nodes=block, hot=hot))
    node = {r["doc_id"]: r["node"] for r in sets.collect()}
    comp = {r["node"]: r["component"] for r in groups.collect()}
    least = {}
    for i, n in sorted(node.items()):
        least.setdefault(comp.get(n, n), i)
    have = Counter((i, least[comp.get(n, n)]) for i, n in node.items())
    assert have == Counter((k, c) for k, _, c in brute_components(rows, 5, 80).elements())


def test_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, are documents of their own."""
    a, b, c = "a b c d e f", "u v w x y z", "k l m n o p"
    rows = [(None, a), (5, a), (None, b), (None, b), (7, c), (7, "q r s t u v w"), (7, c), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs, 4, 85).collect())
    assert got == Counter([(None, 3, 5), (5, 3, 5), (None, 3, None), (None, 3, None), (7, 3, 7), (7, 3, 7), (7, 4, 7), (3, 0, 3), (None, 0, None)])


def test_one_value_in_most_rows(spark):
    """A third of all rows has one text; a family of near copies fills another third."""
    rows = [(i, "hot text with some words in it") for i in range(400)] + [(400 + i, t) for i, t in enumerate(family(21, 400, 80, 5))] + [(800 + i, f"single {i} of its own kind {i * 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sets = ngram_join.C.stored(ngram_join.sets_of(docs, 4), "sets")
    found = ngram_join.near_duplicates(docs, 4, 85).collect()
    groups = Counter(r["component_id"] for r in found)
    assert groups[0] == 400 and sets.count() == 1200
    want = Counter(c for _, _, c in brute_components(rows[400:800], 4, 85).elements())
    assert Counter(n for k, n in groups.items() if 400 <= k < 800) == Counter(want.values())


def test_few_common_tokens(spark):
    """A bound on the common n-grams changes costs, not results."""
    rows = [(i, t) for i, t in enumerate(family(5, 40) + family(6, 30))]
    sets = ngram_join.C.stored(ngram_join.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), 5), "sets")
    one, two = (connected_components(ngram_join.links(sets, 80, max_common=m)).groupBy("component").count().collect() for m in (3, 1 << 20))
    assert Counter(r["count"] for r in one) == Counter(r["count"] for r in two)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 90), (90, 80), (80, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and {got[i] for i in (80, 90, 100)} == {80}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=1500))
def test_wavelet(ids):
    a = np.array(ids, np.uint32)
    m, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(a).to_bytes(np.array([len(a)])))
    assert m.all().tolist() == ids and lengths.tolist() == [len(a)]
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
        assert m.count(ids[i], i) == ids[:i].count(ids[i])
        assert m.occurrence(ids[i], ids[:i].count(ids[i])) == i
    assert m.count(70000) == 0


ODD = ["a", "b", "cd", "E", " ", " ", " ", "\n", ".", ",", "'s", "12", "é", "!", "\t", "  ", "\n\n", "\xa0", "<|endoftext|>", "\x1c", "漢", "ǅ", "Σ", "İ", "e\u0301", ")", "the", "x" * 60, "_", "\r\n", "\u3000", "\u200b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join) | st.none(), max_size=12), st.sampled_from([300, 1 << 20]))
def test_columns(texts, kept):
    for path, style in ((BYTES, "byte_level"), (WORDS, "words")):
        e = ENCODERS.setdefault((path, kept), _encode.PieceEncoder(path, style, kept))
        ids, long = e.encode(pa.array(texts, pa.string()))
        assert [ids.flat[i:j].tolist() for i, j in zip(ids.start, ids.start[1:])] == [e.whole(t or "") for t in texts] and not long.any()


ENCODERS: dict = {}


def test_columns_in_slices(monkeypatch):
    """What is kept stays within its bound, and slices of a column give what the column gives."""
    texts = [f"word{i * 7919 % 5003} the{i},\nnew" * (i % 7) for i in range(300)] + ["y" * 5000 + " end", None, "tail "]
    e = _encode.PieceEncoder(BYTES, kept_bytes=20_000)
    want, long = e.encode(pa.array(texts), 4096)
    assert long.tolist() == [False] * 300 + [True, False, False]
    monkeypatch.setattr(_encode, "SLICE_BYTES", 500)
    monkeypatch.setattr(_encode.slices_of, "__defaults__", (500,))
    for _ in range(2):
        got, long = e.encode(pa.array(texts), 4096)
        assert got.flat.tolist() == want.flat.tolist() and got.start.tolist() == want.start.tolist() and long.sum() == 1
        assert e.words.nbytes + e.ids.nbytes() < 60_000


def test_slices_give_memory_back(monkeypatch):
    """Between slices, and after the last, Arrow returns what it has freed."""
    pool, given_back, done = pa.default_memory_pool(), [], 0

    class Told:
        def release_unused(self):
            given_back.append(done)
            pool.release_unused()

    monkeypatch.setattr(pa, "default_memory_pool", Told)
    for some in _encode.slices_of(pa.array(["a" * 400, None, "b" * 400, "c"]), 300):
        done += len(some)
    assert done == 4 and given_back == [1, 2, 3, 4]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdeAB é\U0001f600", min_size=1, max_size=400), st.integers(1, 40), st.sampled_from([4, 16, 64]))
def test_tree(text, times, leaf):
    tree, text = TREES.setdefault(leaf, bpe_tree.TreeEncoder(BYTES, leaf)), (text.replace(" ", "") or "a") * times
    assert tree.encode(text) == Tokenizer.from_file(BYTES).encode(text).ids if times == 1 else tree.encode(text) == tree.tok.encode(text).ids


TREES: dict = {}


@pytest.mark.parametrize("space", ["\n\n", "\n", "  ", " ", "\t \n", "\u00a0\n"])
def test_white_space_before_unsplit_text(space):
    tree, long = bpe_tree.TreeEncoder(BYTES), "abcde" * 1000
    for text in (f"a{space}{long}{space}b", f"{space}{long}{space}", f"a{space}<|endoftext|>{space}{long}{space}{long} c"):
        assert any(unsplit for unsplit, _ in tree.parts(text)) and tree.encode(text) == tree.tok.encode(text, add_special_tokens=False).ids


def test_encode_white_space_before_unsplit_text(spark):
    text = "a\n\n" + "abcde" * 1000 + "\n\nthe end"
    have = bpe_tree.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES).collect()
    assert np.frombuffer(have[0]["ids"], "<u4").tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("zeros", ["padded", "random"])
def test_exact_search_with_zeros(zeros):
    rnd = np.random.default_rng(3)
    values = np.floor(32 * rnd.normal(size=(4000, 64))).astype(np.int64)
    values = values * (np.arange(64) < 32) if zeros == "padded" else values * (rnd.random(values.shape) < 0.2)
    index = topk.ImpactIndex(np.arange(4000), values)
    for own in range(40):
        scores = values @ values[own]
        want = [j for j in np.lexsort((np.arange(4000), -scores)) if j != own][:5]
        ids, got = index.search(values[own], 5, own)
        assert ids.tolist() == want and got.tolist() == scores[want].tolist()


def test_decoder_bad_utf8():
    tok = Tokenizer.from_file(BYTES)
    d = bpe_tree.Decoder(tok)
    ids = tok.encode("é\U0001f600 x", add_special_tokens=False).ids
    cuts = [ids[:1], ids[:2], [], ids[1:], [50256, *ids]]
    got = d.decode(np.array(sum(cuts, []), np.uint32), np.cumsum([0, *map(len, cuts)]))
    assert [x.decode() for x in got] == [tok.decode(c, skip_special_tokens=False) for c in cuts]
    assert d.decode(np.zeros(0, np.uint32), np.array([0, 0])) == [b""]


@pytest.mark.parametrize("fan", [2, 16])
def test_rounds_of_joins(spark, fan):
    """Very long unsplit texts among others, under repeated ids, joined over several rounds."""
    texts = ["ab1" * 9000 + " x", "plain text", None, "é" * 20000 + " <|endoftext|> " + "q" * 7000, "a,b;" * 3000, "plain text", " " * 9000]
    docs = spark.createDataFrame([(7 if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    encoded = bpe_tree.encode(docs, BYTES, leaf=512, fan=fan)
    tok = Tokenizer.from_file(BYTES)
    want = Counter((7 if i % 2 else i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in encoded.collect()) == want
    assert Counter(bytes(r["decoded"]).decode() for r in bpe_tree.decode(encoded, BYTES).collect()) == Counter(t or "" for t in texts)


def test_repeated_ids_in_files(spark):
    """An id that most rows have is dealt over tasks; every row is there once, without gaps."""
    rows = [(5, f"text {i % 40}") for i in range(300)] + [(None, "x"), (None, None), (1, "first"), (9, "last " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shards = wavelet.write_shards(docs, BYTES, shard_ids=64)
    got = sorted(wavelet.read_shards(shards).collect(), key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] or 0 for r in got] == sorted(r["doc_id"] or 0 for r in got)


def test_one_access_unpacks_few_blocks():
    ids = np.random.default_rng(1).integers(0, 50000, 1 << 19, dtype=np.uint32)
    m, _ = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes(np.array([len(ids)])))
    assert m.access(12345) == ids[12345] and all(len(p.blocks) <= 2 < len(p.spans) for p in m.planes)
    assert m.count(int(ids[7])) == (ids == ids[7]).sum() and m.all().tolist() == ids.tolist()


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns(histogram):
    used = Counter()
    for count, items in packing.shortest_pack_first(histogram, 64):
        assert sum(x for x, _ in items) <= 64
        for length, first in items:
            used.update((length, first + j) for j in range(count))
    assert used == Counter((k, j) for k, n in histogram.items() for j in range(n))


def test_fingerprint_is_homomorphic(spark):
    parts = ["one two three four", "alpha beta", "", "gamma delta epsilon zeta eta"]
    texts = [("whole", "\n".join(parts)), ("turned", "\n".join(parts[::-1])), *[(str(i), p) for i, p in enumerate(parts)], ("rest", "\n".join(parts[1:]))]
    got = {r["k"]: r["fp"] for r in fingerprint.vectors(spark.createDataFrame(texts, "k string, text string"), ["k"]).select("k", fingerprint.lanes().alias("fp")).collect()}
    mod = lambda v: [x % 2**32 for x in v]
    assert got["whole"] == got["turned"] == mod(np.sum([got[str(i)] for i in range(4)], 0).tolist())
    assert got["rest"] == mod((np.array(got["whole"]) - np.array(got["0"])).tolist())


@pytest.mark.parametrize("buckets,level", [(1, 4), (4, 4), (30, 4), (16, 1024)])
def test_next_documents(spark, buckets, level):
    """Every row's next one, with an id that a third of all rows have, null ids and few or many buckets."""
    rows = [(i, f"t{i}") for i in range(60)] + [(70, f"h{i}") for i in range(40)] + [(None, f"n{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.with_next(docs, buckets, level).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    after = {r["text"]: r["next_text"] for r in got}
    assert len(set(after.values())) == len(rows)
    ids = dict((t, k) for k, t in rows)
    at, seen = next(t for t in after if ids[t] is None), []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == len(rows) and all(after[f"t{i}"] == f"t{i + 1}" for i in range(59))
    turn = [ids[t] if ids[t] is not None else -1 for t in seen]
    assert sum(a > b for a, b in zip(turn, turn[1:] + turn[:1])) == 1
    if buckets >= 16:
        assert max(Counter(r["bucket"] for r in got).values()) < 40
    for n in (1, 0):
        alone = fingerprint.with_next(docs.where("doc_id = 5").limit(n), buckets, level).collect()
        assert [(r["text"], r["next_text"]) for r in alone] == [("t5", "t5")][:n]


def test_shards_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i // 4}") for i in range(900)] + [(i, f"single{i}") for i in range(900, 1800)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, key string"), "key", shards=10).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) == {180} and len({(r["shard"], r["slot"]) for r in got}) == 1800
    hot = Counter(r["shard"] for r in got if r["key"] == "hot")
    assert len(hot) <= 8  # they start in ten shards
    groups = {}
    for r in got:
        groups.setdefault(r["key"], set()).add(r["shard"])
    small = [g for k, g in groups.items() if k.startswith("g")]
    assert sum(len(g) == 1 for g in small) >= 0.9 * len(small)


def test_full_shards_exchange(spark):
    """All documents are linked and there is no room: groups gather by exchanges, and counts stay even."""
    rows = [(i, f"g{i % 300}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, key string")
    got = sharding.shard_rows(docs, "key", shards=10).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {180}
    cells = Counter((r["key"], r["shard"]) for r in got)
    together = sum(n * (n - 1) for n in cells.values()) / (1800 * 5)
    assert together > 0.6  # dealt at random: a tenth


def test_salts_spread(spark):
    """Rows that a first rank has put together are spread anew by the second."""
    first = sharding.C.dealt_rank(spark.range(20000).withColumnRenamed("id", "_row"), [], ["_row"], "_rank").where("_rank < 500").select("_row")
    salt = F.pmod(F.xxhash64(F.lit("slot:"), "_row"), F.lit(64))
    assert first.groupBy(salt).count().agg({"count": "max"}).first()[0] < 30


def test_a_hot_group_converges(spark):
    """A third of all rows has one text, in forty shards: rounds are needed for each shard it leaves."""
    rows = [(i, "hot" if i % 3 == 0 else f"single{i}") for i in range(12000)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, key string"), "key").collect()
    assert set(Counter(r["shard"] for r in got).values()) == {300}
    assert len({r["shard"] for r in got if r["key"] == "hot"}) <= 15  # 14 would hold it


def test_backoff():
    m = language_id.LanguageModel(("a", "b"), {"word": 0}, np.log([[0.9, 0.1]]), {"xy": 0, "x": 1, "z": 2}, np.log([[0.2, 0.8], [0.5, 0.5], [0.9, 0.1]]), 4)
    s = language_id.Scorer(m)
    assert s.predict("Word, word!")[0] == "a" and s.predict("xyxy")[0] == "b" and s.predict("123 ...") == ("und", 0.0)
    assert np.allclose(s.word("xyxz"), np.log([0.2 * 0.5 * 0.9, 0.8 * 0.5 * 0.1]))


def brute_prediction(model, text):
    """Words, then the longest known n-grams from the left, one at a time."""
    sums, n = [0.0] * len(model.langs), 0
    word, words = "", []
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        n += 1
        if w in model.words:
            units = [model.word_logp[model.words[w]]]
        else:
            units, at = [], 0
            while at < len(w):
                k = next((k for k in (4, 3, 2, 1) if w[at : at + k] in model.grams and len(w) - at >= k), None)
                units += [model.gram_logp[model.grams[w[at : at + k]]]] if k else []
                at += k or 1
        for u in units:
            sums = [a + float(b) for a, b in zip(sums, u)]
    if not n or not sums:
        return "und", 0.0
    best = max(range(len(sums)), key=lambda i: (sums[i], -i))
    return model.langs[best], 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums)


def test_language_by_brute_force(spark):
    """Model counts and predictions, over the small table and odd texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    texts = [r["text"] for r in docs.select("text").collect()] + ["½ ² 50", "Ⅷ", "x²", "ǅ", None, "", "  ", "a" * 70000, "ſtraße ŒUVRE"]
    names, scores = language_id.Scorer(model).predict_column(pa.array(texts, pa.string()))
    for t, name, score in zip(texts, names, scores):
        want = brute_prediction(model, t)
        assert name == want[0] and abs(score - want[1]) < 1e-6, t


def test_language_learns_all_units(spark):
    """Every word and n-gram of the sample, long words too; repeated rows teach once, null labels nothing."""
    words = {"a": ["x" * 200 + "y" * 3, "w²orld", "über"], "b": ["q" * 61, "z" * 62 + "k"]}
    rows = [(i, " ".join(ws), lang) for i, (lang, ws) in enumerate(words.items())]
    docs = spark.createDataFrame(rows * 3 + [(9, "nothing", None), (None, "nothing", "a")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    units = {"a": ["x" * 200 + "y" * 3, "w", "orld", "über"], "b": words["b"]}
    assert set(model.words) == {w for ws in units.values() for w in ws} and model.langs == ("a", "b")
    grams = {lang: Counter(w[i : i + k] for w in ws for k in (1, 2, 3, 4) for i in range(len(w) - k + 1)) for lang, ws in units.items()}
    assert set(model.grams) == set(grams["a"]) | set(grams["b"])
    for g, i in model.grams.items():
        for j, lang in enumerate("ab"):
            total = sum(grams[lang].values()) + 0.5 * (len(model.grams) + 1)
            assert abs(model.gram_logp[i, j] - math.log((grams[lang][g] + 0.5) / total)) < 1e-9


def test_letters_only(spark):
    docs = spark.createDataFrame([(1, "hello world", "en"), (5, "½ ² 50", None), (6, "Ⅷ", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert got == {1: "en", 5: "und", 6: "und"}


def test_wide_components(spark):
    """Scores beyond 32 bits, beyond the exact floats and up to 64 bits."""
    rows = [(0, [1.0, 0.5]), (1, [1e7, 0.5]), (2, [2.0, 1.0]), (3, [-3.0, 1.0]), (4, [1e13, 3.0]), (5, [1e13, 4.0]), (50, [10.0, 7.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>").select("id", topk.quantised(F.col("e")).alias("v"))
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df.where("id % 50 = 0"), df, 5, block_rows=3).collect()}
    for q in (0, 50, 100):
        want = sorted(((sum(a * b for a, b in zip(v[q], v[i])), -i) for i in v if i != q), reverse=True)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(-i, s) for s, i in want]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([(1, [1e30])], "id long, e array<double>").select(topk.quantised(F.col("e")).alias("v")).collect()


def test_long_chains(spark):
    """A chain in ascending order takes few rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_redaction():
    t = 'x token = "abcdef123" y\n'
    assert secret_scan.redacted(t, secret_scan.base_spans(t)) == 'x [SECRET]" y\n'
    weak = "client_id = svc\n\nZx9kQ2mLw8Tr4Vb7Yn3C"
    assert secret_scan.linked(weak, []) == []  # the parts stand in different scopes


ACCESS, OPAQUE = "AK" + "IA" + "ABCDEFGHIJKLMNOP", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz9kQ2mLw8"


def test_value_beside_an_access_key():
    for t in (f"{ACCESS} {OPAQUE}", f"keys {ACCESS}: {OPAQUE}\n"):
        spans = secret_scan.base_spans(t)
        assert [t[a:b] for a, b, _ in secret_scan.linked(t, spans)] == [OPAQUE]
        assert OPAQUE not in secret_scan.redacted(t, spans + secret_scan.linked(t, spans))
    assert secret_scan.linked(f"alone {OPAQUE}", []) == []


@pytest.mark.parametrize("before", [0, 1, 1980, 1990, 2000, 3990, 4001])
def test_scope_does_not_depend_on_the_place(before):
    for gap, n in ((" ", 2), ("\n", 2), (" " * 1900, 2), (" " * 2000, 2), (" " * 2001, 0), ("\n\n", 0), ("\nx\n", 0)):
        for parts in (("client_id=svc-main", OPAQUE), (OPAQUE, "client_id=svc-main")):
            t = "." * before + " " + gap.join(parts)
            n_here = n if parts[1] == OPAQUE or len(gap) < 1900 else None  # the key's name is no part of the span
            got = secret_scan.linked(t, [])
            assert n_here is None or len(got) == n_here


def test_links_by_brute_force():
    rnd = random.Random(5)
    pieces = ["client_id=svc-main", OPAQUE, ACCESS, "https://api.example.org/v1", "token=abcdefgh", "0123456789abcdef" * 2, "word", "\n", "\n\n", " " * 30]
    for _ in range(300):
        t = " ".join(rnd.choice(pieces) for _ in range(12))
        strong = secret_scan.base_spans(t)
        weak = secret_scan.weak_candidates(t, strong)
        line = lambda s: t.count("\n", 0, s[0])
        want = set()
        for w in weak:
            for p in [*weak, *strong]:
                if p[2] in secret_scan.PARTNERS[w[2]] and max(w[0], p[0]) - min((w, p))[1] <= 60 and abs(line(w) - line(p)) <= 1:
                    want.add(w)
        want = {w for w in want if w[2] != "value" or not any(s < w[1] and e > w[0] for s, e, _ in strong)}
        assert set(secret_scan.linked(t, strong, 60)) == want


def test_pipeline(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns, name
        before, docs = docs, out.persist()
        assert docs.count() <= before.count()
        if name == "ngram_join":
            ids = [r["doc_id"] for r in docs.collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.collect()}
            kept = {k for k, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80) if k == c}
            assert set(ids) == kept
        if name == "secret_scan":
            assert docs.count() == before.count() and not any(secret_scan.base_spans(r["text"]) for r in docs.collect())
    held = {r["doc_id"] for r in docs.collect()}
    assert held == {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).collect()}
    assert held and corpus_pipeline.run(spark, odd_dir).count() > 0


def test_pipeline_on_empty_table_and_clashing_names(spark, empty, empty_dir, odd):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    docs = odd.withColumn("_row", F.lit(1)).withColumn("_language", F.lit("x")).withColumn("row", F.lit(2)).withColumn("component_id", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, empty_dir).count() == 0
        out = stage(spark, docs, empty_dir)
        assert out.columns == docs.columns and {(r["_row"], r["_language"], r["row"], r["component_id"]) for r in out.collect()} == {(1, "x", 2, 3)}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, empty_dir).count() > 0


def test_near_copies_are_rows_not_ids(spark):
    a, b, c, d = (f[0] for f in (family(11, 1), family(12, 1), family(13, 1), family(14, 1)))
    rows = [(1, a), (1, b), (1, c), (2, b), (None, d), (None, d), (None, d + " more"), (3, c), (0, c), (4, "short"), (4, "other"), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    have = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    rest = Counter([(1, a), (1, b), (0, c), (4, "short"), (4, "other"), (5, ""), (5, None)])
    assert have - rest in (Counter([(None, d)]), Counter([(None, d + " more")])) and not rest - have


def test_notice_in_a_file_of_many_licence_words():
    """A notice of frequent words is found beside more than 24 rarer licence words."""
    everything = [w for t in license_scan.templates() for w in t.words]
    notice = b"licensed under cc by 4 0".split()
    frequency = {w: 900 if w in notice else 3 for w in everything}
    index = license_scan.build_index(frequency, 1000)
    rest = sorted(set(everything) - set(notice))
    assert len(rest) > 200
    assert license_scan.scan([*rest, b"end", *notice], index)["labels"] == ["cc-by", "cc-by-4.0"]
    assert license_scan.scan([*notice, b"end", *rest, b"end"] * 30, index)["labels"] == ["cc-by", "cc-by-4.0"]


def test_whole_licence_texts():
    """Whole texts are found also with a name put in and some words changed, and not with a third of them gone."""
    index = license_scan.build_index({w: 5 for t in license_scan.templates() for w in t.words}, 1000)
    for text, label, _ in license_scan.TEXTS:
        words = license_scan.words_of(text.encode())
        assert label in license_scan.scan([b"copyright", b"someone", *words, b"end"], index)["labels"]
        assert label in license_scan.scan([*words[:-6], b"other", *words[-5:]], index)["labels"]
        cut = [b"x" if i % 3 == 0 else w for i, w in enumerate(words)]
        assert label not in license_scan.scan(cut, index)["labels"]


def test_notices_by_brute_force():
    rnd = random.Random(7)
    found = license_scan.templates()
    everything = sorted({w for t in found for w in t.words})
    for _ in range(150):
        index = license_scan.build_index({w: rnd.randrange(1000) for w in everything}, 1000)
        words = []
        for _ in range(rnd.randrange(1, 8)):
            part = list(rnd.choice(found).words)
            for _ in range(rnd.randrange(3)):
                part[rnd.randrange(len(part))] = rnd.choice([b"other", rnd.choice(everything)])
            words += part[rnd.randrange(2) :] + rnd.choices(everything, k=rnd.randrange(20))
        labels, best = set(), 0.0
        for t in found:
            whole = sum(index.idf[w] for w in t.words)
            for start in range(-len(t.words), len(words)):
                here = sum(index.idf[w] for j, w in enumerate(t.words) if 0 <= start + j < len(words) and words[start + j] == w)
                ends = range(max(0, start - 4), min(len(words), start + len(t.words) + 4))
                if t.base and start >= 0 and tuple(words[start : start + len(t.words)]) == t.words:
                    labels.add(t.label)
                    best = 1.0
                elif not t.base and here >= 0.8 * whole and all(any(tuple(words[i : i + len(k)]) == k for i in ends) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, min(1.0, here / whole))
        got = license_scan.scan(words, index)
        assert got["labels"] == sorted(labels) and abs(got["score"] - best) < 1e-9


def test_many_queries_share_a_product(monkeypatch):
    """Copies, repeated ids, queries without weight, few rows, segments in several slabs; no query is searched alone."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    v[100:140], v[7], v[8, :20], v[9:12] = v[3], 0, 0, -v[3]
    ids = np.arange(900) // 2 * 3
    monkeypatch.setattr(topk.ImpactIndex, "search", None)
    for n, slab in ((900, 1 << 26), (900, 4 * 900 * 10), (6, 1 << 26), (1, 1 << 26)):
        monkeypatch.setattr(topk, "SEGMENT_BYTES", slab)
        index = topk.ImpactIndex(ids[:n], v[:n])
        for _ in range(2):  # the second time it begins where most proofs came
            at, found, score = index.search_all(v[:150], 5, ids[:150])
            for i in range(150):
                other = np.flatnonzero(ids[:n] != ids[i])
                s = v[other] @ v[i]
                want = np.lexsort((ids[other], -s))[:5]
                assert (score[at == i] == s[want]).all() and (found[at == i] == ids[other][want]).all()
