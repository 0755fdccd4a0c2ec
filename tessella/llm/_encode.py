"""Encoding whole columns of texts with the `tokenizers` library, each distinct word once.

Both vocabularies split a text at white space before any merge is made, so a
text can be cut at such places.  A slice of texts is cut into pieces in Arrow,
equal pieces are found by a dictionary, the library encodes each word that has
not been seen yet, and the ids are dealt back to the pieces by array indices; no
piece becomes a Python object.  Pieces are cut only where the cut cannot change
a pre-token; texts with anything unusual (special-token strings, control
characters) are given to the library whole.

What is kept from slice to slice is a table of words and ids in flat arrays,
bounded by bytes; a slice has a bounded size too, so a worker's memory depends
on neither the corpus nor the number of its words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm import _common as C

#: White space other than the plain space and line feed.
_OTHER = "\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　"
#: A text without any of these is cut at every space and line feed.
_IRREGULAR = f"  | \n|\n |\n\n|\\A[ \n]|[ \n]\\z|[{_OTHER}]"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Marks that are a pre-token of their own after a letter or digit.
_TAIL = ".,;:!?#$%&*)"
#: In lower case the dotted capital I ends with a mark, and marks after it would join that.
_LETTER_LAST = r"(?:\pN|[^\PLİ])$"
_CONTROL = "[\x1c-\x1f]"

#: Bytes of words and ids that a Python worker keeps.
KEPT_BYTES = 24 << 20
#: Words longer than this are encoded but not kept.
KEPT_WORD_BYTES = 48
#: Texts are taken in slices of about so many bytes.
SLICE_BYTES = 4 << 20


class Table:
    """Rows of ids: row i is flat[start[i] : start[i + 1]]."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.start = flat, np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))

    @classmethod
    def of(cls, rows: list[list[int]]) -> Table:
        return cls(np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64))

    def __len__(self) -> int:
        return len(self.start) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.start)

    def take(self, rows: np.ndarray) -> Table:
        lengths = self.lengths()[rows]
        out = Table(self.flat[:0], lengths)
        at = np.arange(out.start[-1], dtype=np.int32 if max(out.start[-1], len(self.flat)) < 1 << 31 else np.int64)
        at += np.repeat((self.start[rows] - out.start[:-1]).astype(at.dtype), lengths)
        out.flat = self.flat[at]
        return out

    def __add__(self, other: Table) -> Table:
        return Table(np.concatenate((self.flat, other.flat)), np.concatenate((self.lengths(), other.lengths())))

    def nbytes(self) -> int:
        return self.flat.nbytes + self.start.nbytes


_NO_IDS = Table(np.zeros(0, np.uint32), np.zeros(0, np.int64))


class PieceEncoder:
    """style "byte_level": byte-level BPE whose pre-tokens may start with one space.
    style "words": BPE with word ends that drops white space."""

    def __init__(self, path: str, style: str = "byte_level", kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.style, self.kept_bytes = style, kept_bytes
        self.lead = "" if style == "words" else " "
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.edge[i] = token.endswith("</w>") if style == "words" else token.startswith("Ġ")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.used = pa.array([], pa.string()), _NO_IDS, np.zeros(0, np.int32)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> Table:
        return Table.of([e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])

    def _joined(self, words: pa.Array, some: int = 2000) -> Table:
        """Words of which each has one token that starts (or ends) it, many in one call."""
        out = []
        cuts = [*range(0, len(words), some), len(words)]
        for text, i, j in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), " ").to_pylist(), cuts, cuts[1:]):
            ids = np.array(self.tok.encode_batch_fast([self.lead + text], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.flatnonzero(self.edge[ids])
            ends = edge + 1 if self.style == "words" else np.append(edge[1:], len(ids))
            if len(ends) == j - i:
                out.append(Table(ids, np.diff(ends, prepend=0)))
            else:  # a word with marks of its own
                out.append(self._each([self.lead + w for w in words.slice(i, j - i).to_pylist()]))
        return Table(np.concatenate([t.flat for t in out]), np.concatenate([t.lengths() for t in out]))

    def _encode_words(self, words: pa.Array) -> Table:
        """Distinct words; one that starts with a line feed has no space before it."""
        plain = pc.match_substring_regex(words, r"^\pL+$") if self.style == "words" else pc.invert(pc.match_substring_regex(words, "[ \n]"))
        plain = plain.to_numpy(zero_copy_only=False)
        if plain.all() and len(words):
            return self._joined(words)
        rest = [w if w[:1] == "\n" else self.lead + w for w in words.filter(pa.array(~plain)).to_pylist()]
        parts = self._joined(words.filter(pa.array(plain))) if plain.any() else _NO_IDS
        parts = parts + self._each(rest)
        back = np.empty(len(words), np.int64)
        back[np.flatnonzero(plain)], back[np.flatnonzero(~plain)] = np.arange(plain.sum()), np.arange(plain.sum(), len(words))
        return parts.take(back)

    def _ids_of(self, words: pa.Array) -> Table:
        """Ids of distinct words, from what is kept or anew."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy() if len(self.words) else np.full(len(words), -1)
        known = at >= 0
        self.used[at[known]] += 1
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids.take(at)
        fresh = words.take(pa.array(new))
        got = self._encode_words(fresh)
        at = at.astype(np.int64)
        at[new] = len(self.ids) + np.arange(len(new))
        out = (self.ids + got).take(at)
        short = pc.less_equal(pc.binary_length(fresh), KEPT_WORD_BYTES).to_numpy(zero_copy_only=False)
        self.words = pa.concat_arrays([self.words, fresh.filter(pa.array(short))])
        self.ids = self.ids + got.take(np.flatnonzero(short))
        self.used = np.concatenate((self.used, np.ones(short.sum(), np.int32)))
        if self.words.nbytes + self.ids.nbytes() > self.kept_bytes:  # words that have come again stay, if they are no more than half
            often = np.flatnonzero(self.used > 1)
            if len(often) * 2 > len(self.used):
                often = often[np.argsort(-self.used[often], kind="stable")[: len(self.used) // 2]]
            self.words, self.ids, self.used = self.words.take(pa.array(often)), self.ids.take(often), np.ones(len(often), np.int32)
        return out

    def _ids_of_pieces(self, pieces: pa.Array) -> Table:
        """Distinct pieces: a word, and the marks after it."""
        stem = pc.utf8_rtrim(pieces, _TAIL)
        stem = pc.if_else(pc.match_substring_regex(stem, _LETTER_LAST), stem, pieces)
        tail = self._tails(pieces, stem)
        words, tails = stem.dictionary_encode(), tail.dictionary_encode()
        marks = [self.whole(t) if t else [] for t in tails.dictionary.to_pylist()]
        table = self._ids_of(words.dictionary)
        n = len(table)
        both = np.stack((words.indices.to_numpy(), n + tails.indices.to_numpy()), 1).ravel()
        out = (table + Table.of(marks)).take(both)
        return Table(out.flat, out.lengths().reshape(-1, 2).sum(1))

    @staticmethod
    def _tails(pieces: pa.Array, stem: pa.Array) -> pa.Array:
        """What stands in each piece after its stem: at most the marks of `_TAIL`, one byte each."""
        size = (pc.binary_length(pieces).to_numpy() - pc.binary_length(stem).to_numpy()).astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1 : pieces.offset + len(pieces) + 1]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        at = np.arange(offsets[-1]) + np.repeat(ends - size - offsets[:-1], size)
        return pa.StringArray.from_buffers(len(pieces), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[at]))

    def _slice(self, texts: pa.Array, long: int | None) -> tuple[Table, np.ndarray]:
        n = len(texts)
        flag = lambda mask: mask.to_numpy(zero_copy_only=False).astype(bool)
        odd = np.zeros(n, bool)
        for s in self.special:
            odd |= flag(pc.match_substring(texts, s))
        if self.style == "words":
            odd |= flag(pc.match_substring_regex(texts, _CONTROL))
            irregular = np.zeros(n, bool)
        else:
            irregular = flag(pc.match_substring_regex(texts, _IRREGULAR)) & ~odd
        single = odd | irregular
        kept = pc.if_else(pa.array(single), "x", texts) if single.any() else texts
        if self.style == "words":
            parts = pc.utf8_split_whitespace(kept)
        else:
            parts = pc.split_pattern(pc.replace_substring(kept, "\n", " \n"), " ")
        if irregular.any():
            by_space = pa.array([_LONE_SPACE.split(t) for t in texts.filter(pa.array(irregular)).to_pylist()], pa.list_(pa.string()))
            where = np.arange(n)
            where[irregular] = n + np.arange(irregular.sum())
            parts = pa.concat_arrays([parts, by_space]).take(pa.array(where))
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, pieces = offsets - offsets[0], parts.flatten()
        # rows that are given apart: texts that go whole, and first pieces, which have no space before them
        apart: list[tuple[np.ndarray, Table]] = []
        too_long = np.zeros(n, bool)
        if long is not None:
            large = np.flatnonzero(pc.binary_length(pieces).to_numpy() > long)
            too_long[np.searchsorted(offsets, large, "right") - 1] = True
            for i in np.flatnonzero(odd):
                too_long[i] = any(len(p.encode()) > long for p in _LONE_SPACE.split(texts[int(i)].as_py()))
        whole = np.flatnonzero(odd & ~too_long)
        if self.style != "words":
            first = np.flatnonzero(~odd & ~too_long)
            bare = pieces.take(pa.array(offsets[first])).to_pylist()
            apart.append((offsets[first], self._each(bare)))
        if len(whole):
            apart.append((offsets[whole], self._each(texts.take(pa.array(whole)).to_pylist())))
        named = pieces.dictionary_encode()
        rows = named.indices.to_numpy().astype(np.int64)
        skip = np.zeros(len(rows), bool)
        for at, _ in apart:
            skip[at] = True
        if too_long.any():
            skip |= np.repeat(too_long, np.diff(offsets))
        used = np.zeros(len(named.dictionary), bool)
        used[rows[~skip]] = True
        place = np.cumsum(used) - 1
        table = self._ids_of_pieces(named.dictionary.filter(pa.array(used)))
        rows = place[rows]
        for at, got in apart:
            rows[at] = len(table) + np.arange(len(at))
            table = table + got
        if too_long.any():
            rows[np.repeat(too_long, np.diff(offsets))] = len(table)
            table = table + Table(_NO_IDS.flat, np.zeros(1, np.int64))
        out = table.take(rows)
        return Table(out.flat, np.diff(out.start[offsets])), too_long

    def encode(self, texts: pa.Array, long: int | None = None) -> tuple[Table, np.ndarray]:
        """Ids of every text of a column (null: none); and which have, between lone
        spaces, more than `long` bytes without a break: those get no ids."""
        parts = [self._slice(s, long) for s in slices_of(texts)]
        if len(parts) == 1:
            return parts[0]
        tables = [t for t, _ in parts] or [_NO_IDS]
        return Table(np.concatenate([t.flat for t in tables]), np.concatenate([t.lengths() for t in tables])), np.concatenate([m for _, m in parts] or [np.zeros(0, bool)])


def slices_of(texts: pa.Array, most: int = SLICE_BYTES):
    """A column of texts in slices of about so many bytes, nulls as empty texts.

    What Arrow has freed since the last slice goes back to the system; else a worker keeps the most it ever took.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        # a copy, so that offsets count from the slice's start
        yield pa.concat_arrays([texts.slice(at, to - at).cast(pa.string()).fill_null(""), pa.array([], pa.string())])
        at = to
        pa.default_memory_pool().release_unused()


def shared_encoder(path: str, style: str = "byte_level") -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs, so what it has learnt is not lost between them."""
    return C.kept(("encoder", path, style), lambda: PieceEncoder(path, style))
