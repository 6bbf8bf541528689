"""Token ids of whole texts, with the ids of repeated words looked up instead of computed again."""

from __future__ import annotations

from array import array
import functools
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# words of each of two generations kept per worker process, some 45 MB each, and the longest word that is kept
CACHE_WORDS = 150_000
CACHE_CHARS = 64
# texts encoded together
BATCH_CHARS = 3_000_000

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def small_words(text: str) -> str:
    """The text with small letters and its line breaks as spaces.

    Small letters make words meet again more often. Two letters whose small form depends on more than themselves stay.
    """
    if "\u0130" not in text and "\u03a3" not in text:
        text = text.lower()
    return text.replace("\n", " ")


def words_of(text: str) -> list[str]:
    """Pieces for a tokenizer that drops case and white space: no token spans a space or line break."""
    return small_words(text).split(" ")


def spaced_pieces(text: str) -> list[str]:
    """Pieces for a tokenizer that glues a space to the word behind it.

    A space or a line break starts a new piece where a visible character follows; a line break is a piece of
    its own. A piece that begins without a space carries a leading NUL mark.
    """
    if "\x00" in text:
        return safe_pieces(text)
    return ("\x00" + text.replace("\n", " \n \x00")).split(" ")


def safe_pieces(text: str) -> list[str]:
    """The same for any text, cut only at single spaces between visible characters."""
    first, *rest = _SAFE_SPACE.split(text)
    return ["\x00" + first, *("\x00 " + r for r in rest)]


def spaced_text(piece: str) -> str:
    """The text that a piece of ``spaced_pieces`` stands for."""
    if piece.startswith("\x00"):
        return piece[1:]
    return piece if piece == "\n" else " " + piece


# one word of Latin letters, perhaps with a full stop or comma: the tokenizer's own split is known for these
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte (fixed rule of the format)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_alphabet()
_SPACE = _BYTES[32]


def _unsafe(piece: str) -> bool:
    """Whether white space follows the space or line break in front of the piece, so that its cut may be wrong."""
    return piece in ("", "\x00") or (piece != "\n" and piece[piece[0] == "\x00"].isspace())


class _Unsafe(KeyError):
    """A piece whose cut may be wrong."""


class _Known(dict):
    """Ids of pieces, learned when first asked for. A full generation makes place for a new one and is asked once more."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, exactly those of the tokenizer over the whole text."""

    def __init__(self, path: str, pieces: Callable[[str], list[str]], text_of: Callable[[str], str], lower: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pieces, self.text_of, self.lower = pieces, text_of, lower
        self.known, self.tokenize = _Known(self._learn), self.model.tokenize
        self.ends = {sign: self._part(sign) for sign in ".,"}

    def _part(self, part: str) -> bytes:
        """Ids of one piece as the tokenizer's split leaves it."""
        shown = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, piece: str) -> bytes:
        """Ids of a new piece. A plain word goes to the model at once, others through the whole tokenizer."""
        if self.lower:
            begin, shown = "", piece
        elif _unsafe(piece):
            raise _Unsafe(piece)
        else:
            # a piece without the mark has a space before it
            begin, shown = ("", piece[1:]) if piece[0] == "\x00" else (_SPACE, piece)
        if shown.isascii():
            if shown.isalpha():
                return array("I", [t.id for t in self.tokenize(begin + (shown.lower() if self.lower else shown))]).tobytes()
            if shown[-1:] in self.ends and shown[:-1].isalpha():
                return self.known[piece[:-1]] + self.ends[shown[-1]]
        text = self.text_of(piece)
        cut = _PLAIN.fullmatch(text, 1 if text[:1] == " " else 0)
        if cut is None:
            return self._whole(text)
        if cut[2]:
            return self.known[piece[:-1]] + self.ends[cut[2]]
        return self._part(text.lower() if self.lower else text)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """One string of id bytes per text; a null text counts as empty."""
        out = []
        for text in texts:
            text = text or ""
            try:
                out.append(b"".join(map(self.known.__getitem__, self.pieces(text))))
            except _Unsafe:
                out.append(b"".join(self._whole(self.text_of(p)) if _unsafe(p) else self.known[p] for p in safe_pieces(text)))
        return out


# kinds of bytes in pieces of small letters: letters of ASCII and Latin-1 (two bytes, the first 0xC3), digits, signs; 0 for others
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0xC3, *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x27, *range(0x41, 0x5B)]] = 0
_SHOWN = np.array([ord(_BYTES[b]) for b in range(256)], "<u4")
# words that go to the model in one call
TOGETHER = 10_000


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an unsliced large string column, and where each of its values begins and the last one ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[: at[-1]], at


def _kinds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte, and which values have bytes of other kinds."""
    kinds = _KIND[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x9F) & (data[second] != 0xB7)]
    kinds[second] = 1
    # what follows another 0xC3 is no letter, so the value is of the others anyway
    return kinds, np.diff(np.concatenate([[0], np.cumsum(kinds == 0)])[at]) > 0


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class WordEncoder:
    """The same for a tokenizer that drops case and white space and marks the last token of a word.

    Every distinct word of a call is encoded once; words of plain letters, single digits and runs of signs go to the
    model many at a time, pieces with other characters through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.others = Encoder(path, words_of, str, lower=True)
        from tokenizers import Tokenizer, pre_tokenizers

        # distinct words never meet again in a call, so the model's own store of words would only cost
        self.others.model._resize_cache(0)
        self.plain = Tokenizer(self.others.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.others.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.others.model.end_of_word_suffix)]] = True

    def _model(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), TOGETHER):
            some = lengths[i : i + TOGETHER]
            shown = np.full(int(some.sum()) + len(some), 32, "<u4")
            shown[np.arange(int(some.sum())) + np.repeat(np.arange(len(some)), some)] = _SHOWN[_gather(data, starts[i : i + TOGETHER], some)]
            found = np.array(self.plain.encode_batch_fast([shown.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the end of every word")
            ids.append(found)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words and pieces: all ids, where those of each begin, and how many."""
        data, at = _bytes_of(words)
        odd = _kinds(data, at)[1]
        plain, lengths = np.flatnonzero(~odd), np.diff(at)
        ids, some = self._model(data, at[plain], lengths[plain])
        rest = [self.others.known[data[at[i] : at[i + 1]].tobytes().decode()] for i in np.flatnonzero(odd).tolist()]
        counts = np.zeros(len(words), np.int64)
        counts[plain], counts[odd] = some, [len(x) // 4 for x in rest]
        starts = np.zeros(len(words), np.int64)
        starts[plain], starts[odd] = np.cumsum(some) - some, len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")]), starts, counts

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """One string of id bytes per text; a null text counts as empty."""
        cut = pc.split_pattern(pa.array([small_words(t or "") for t in texts], pa.large_string()), " ")
        pieces = pc.dictionary_encode(cut.flatten())
        # pieces into words: a word begins with each piece, where the kind of byte changes, and at every digit
        data, at = _bytes_of(pieces.dictionary)
        kinds, odd = _kinds(data, at)
        begins = (kinds == 2) | (np.diff(kinds, prepend=0) != 0)
        begins &= np.repeat(~odd, np.diff(at))
        begins[at[:-1][np.diff(at) > 0]] = True
        borders = np.append(np.flatnonzero(begins), len(data))
        words = pc.dictionary_encode(pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(data)]))
        ids, starts, counts = self._words(words.dictionary)
        word = words.indices.to_numpy()
        ids, counts = _gather(ids, starts[word], counts[word]), np.concatenate([[0], np.cumsum(counts[word])])
        # from here on ids of pieces, then of texts
        starts = counts[np.searchsorted(borders, at)]
        counts, piece = np.diff(starts), pieces.indices.to_numpy()
        raw = _gather(ids, starts[piece], counts[piece]).astype("<u4", copy=False).tobytes()
        ends = np.concatenate([[0], np.cumsum(counts[piece])])[cut.offsets.to_numpy()]
        return [raw[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str) -> Encoder:
    return Encoder(path, spaced_pieces, spaced_text, lower=False)


def batches(texts: Sequence[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
