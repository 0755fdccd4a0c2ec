"""Language identification by words first, shorter and shorter character n-grams next.

A known word scores by its smoothed log frequency in each language.  A word
that no language has is covered from the left by the longest n-gram that the
model knows (4, then 3, 2 and 1 letters); each n-gram scores by its log
frequency.  A document's language has the largest sum; its score is that
language's share under a softmax of the sums.

Learning: a sample of at most `sample_per_lang` labelled documents of each
language, those of the smallest hashes of id and text (a documented bound; the
classifier is all that is sampled).  All words and n-grams of the sample are learnt, whatever
their number or length, so what is broadcast is bounded by the sample.  Languages
are expected to be few (a column of the model each).

Words are runs of letters (Unicode category L) of the lower-cased text, in
learning and in predicting.  Nulls and odd input: a null text, or one without
letters, gets `und` and score 0; a row with a null label or id teaches nothing;
with no labelled row, all get `und`; equal scores go to the language first in
order; repeated rows each get their own answer and teach once; an empty table
gives no rows; a very long text is scored whole, slice by slice of its batch; of
other columns nothing is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm import _common as C
from tessella.llm._encode import slices_of

UND = "und"
_LETTERS = regex.compile(r"\p{L}+")
#: Ids of a sample that are sent to every task; more are joined by a shuffle.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    words: dict[str, int]
    word_logp: np.ndarray  # one row per word, one column per language
    grams: dict[str, int]
    gram_logp: np.ndarray
    longest: int


def _counts(units: DataFrame, langs: list[str], smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """units: lang, unit, n.  The units of a bounded sample, and a log frequency for each language."""
    got = units.toArrow()
    names = got.column("unit").combine_chunks().dictionary_encode()
    table = np.zeros((len(names.dictionary), len(langs)))
    table[names.indices.to_numpy(), pc.index_in(got.column("lang").combine_chunks(), value_set=pa.array(langs, pa.string())).to_numpy()] = got.column("n").to_numpy()
    total = table.sum(0) + smooth * (len(table) + 1)
    return {x: i for i, x in enumerate(names.dictionary.to_pylist())}, np.log((table + smooth) / total)


def _grams(words: DataFrame, longest: int, stretch: int = 61) -> DataFrame:
    """words: lang, unit, n.  The same of their n-grams; long words are taken in overlapping stretches, and an
    n-gram counts in the stretch where it starts."""
    starts = F.sequence(F.lit(0), F.expr(f"(length(unit) - 1) div {stretch}").cast("int"))
    part = words.select("lang", "n", F.col("unit").alias("_word"), F.explode(starts).alias("_at"))
    part = part.select("lang", "n", F.substring(F.col("_word"), F.col("_at") * stretch + 1, F.lit(stretch + longest - 1)).alias("_part"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(F.length("_part") >= k, F.transform(F.sequence(F.lit(1), F.least(F.lit(stretch), F.length("_part") - k + 1)), lambda i: F.substring(F.col("_part"), i, k))).otherwise(F.array())))
    return part.select("lang", "n", F.explode(spans).alias("unit")).groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, keep: Column, sample_per_lang: int = 2000, longest: int = 4) -> LanguageModel:
    """docs: doc_id, text, lang.  keep: the rows that may teach."""
    may = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("_hash"))
    counts = C.stored(may.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "language-counts")
    counts = F.broadcast(counts) if counts.count() <= MOST_SENT else counts
    # of a language that has many rows only those of small hashes are ranked, four times as many as are wanted
    u = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "_hash"), 11) / float(1 << 53)
    few = may.select("doc_id", "lang", "_hash", u.alias("_u")).join(counts, "lang").where(F.col("_u") < 4.0 * sample_per_lang / F.col("_n")).drop("_n").distinct()
    order = Window.partitionBy("lang").orderBy("_u", "doc_id", "_hash")
    ranked = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample_per_lang)
    chosen = C.stored(ranked.select("doc_id", "lang", "_hash"), "language-sample")
    chosen = F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen
    sample = may.join(chosen, ["doc_id", "lang", "_hash"], "left_semi").dropDuplicates(["doc_id", "lang", "_hash"])
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("unit"))
        .groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
    )
    words = C.stored(words, "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    w, wp = _counts(words, langs, 0.5)
    g, gp = _counts(_grams(words, longest), langs, 0.5)
    return LanguageModel(tuple(langs), w, wp, g, gp, longest)


class Scorer:
    """Sums by language of texts' words.  Pieces between white space are scored once for each slice of texts."""

    LIMIT = 200_000

    def __init__(self, model: LanguageModel):
        self.m = model
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.m.langs) + 1))

    def word(self, word: str) -> np.ndarray:
        """Backs off to n-grams where the word itself is not known."""
        m = self.m
        if (i := m.words.get(word)) is not None:
            return m.word_logp[i]
        out, at = np.zeros(len(m.langs)), 0
        while at < len(word):
            for k in range(min(m.longest, len(word) - at), 0, -1):
                if (i := m.grams.get(word[at : at + k])) is not None:
                    out = out + m.gram_logp[i]
                    break
            at += k
        return out

    def piece(self, piece: str) -> np.ndarray:
        """The last number counts words."""
        out = np.zeros(len(self.m.langs) + 1)
        for w in _LETTERS.findall(piece.lower()):
            out[:-1] += self.word(w)
            out[-1] += 1
        return out

    def _rows_of(self, pieces: list[str]) -> np.ndarray:
        """Distinct pieces to rows of sums."""
        if len(self.cache) + len(pieces) > self.LIMIT:
            self._forget()
        at = np.fromiter((self.cache.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        first, need = len(self.cache), len(self.cache) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows[:first], np.zeros((max(need, 2 * first) - first, self.rows.shape[1]))))
        for row, i in enumerate(new.tolist(), first):
            self.rows[row] = self.piece(pieces[i])
            self.cache[pieces[i]] = row
        at[new] = np.arange(first, need)
        return self.rows[at]

    def sums(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: sums by language, and the number of words."""
        parts = pc.utf8_split_whitespace(texts)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, named = offsets - offsets[0], parts.flatten().dictionary_encode()
        out = np.zeros((len(texts), len(self.m.langs) + 1))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(self._rows_of(named.dictionary.to_pylist())[named.indices.to_numpy()], offsets[full], axis=0)
        return out

    def predict_column(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """lang_pred and score of each text of a column."""
        names: list[str] = []
        scores: list[float] = []
        for some in slices_of(texts, 4 << 20):
            if not self.m.langs:
                names += [UND] * len(some)
                scores += [0.0] * len(some)
                continue
            s = self.sums(some)
            known, s = s[:, -1] > 0, s[:, :-1]
            best = s.argmax(1)
            share = 1 / np.exp(np.maximum(s - s.max(1, keepdims=True), -700)).sum(1)
            names += [self.m.langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist())]
            scores += np.where(known, share, 0.0).tolist()
        return names, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        (name,), (score,) = self.predict_column(pa.array([text], pa.string()))
        return name, score


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, with lang_pred and score."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(model)
    cols = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        scorer = C.kept(("scorer", id(told.value)), lambda: Scorer(told.value))
        for b in batches:
            names, scores = scorer.predict_column(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return cols.mapInArrow(run, schema)


def labelled(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "_language") -> DataFrame:
    """docs with a column `name` (lang_pred, score); only the text goes to Python, and it does not come back."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = C.kept(("scorer", id(told.value)), lambda: Scorer(told.value))
        for texts in batches:
            names, scores = scorer.predict_column(pa.array(texts, pa.string()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn(name, F.pandas_udf(run, "lang_pred string, score double")(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
