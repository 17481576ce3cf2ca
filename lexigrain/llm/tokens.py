"""Token ids of whole texts with public tokenizers, through a bounded cache of ids by word.

A byte-level or word-level BPE never joins characters over the borders at which texts are cut here, so the ids of
a text are the ids of its chunks, one after the other.  Natural text repeats its words, so most chunks are looked
up.  A new chunk of plain Latin letters, digits and marks is cut into the pieces that the tokenizer's own pattern
makes of it, and its model encodes each; any other chunk goes through the whole tokenizer.  So does a text in which
an added token (an end-of-text mark, say) is written out: the library gives it the token's id, and so does this.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and pieces, whose ids a worker remembers before it starts anew.
CACHE_WORDS = 400_000
#: Longest chunk that is remembered.
CACHE_CHARS = 64
#: Bytes of text that a worker handles at once.
SLICE_BYTES = 1 << 19
#: Words whose ids are put side by side at once.
WORDS_AT_ONCE = 1 << 18
#: Where a byte-level text may be cut: before ASCII white space that follows anything else.
_CHUNK = re.compile("[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: White space outside ASCII joins runs of white space over such a cut; texts with it are encoded whole.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What a text of words between single spaces and line breaks neither starts or ends with, nor has inside.
_BREAKS, _DOUBLE = ("", " ", "\n"), ("  ", "\n\n", " \n", "\n ")
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: The endings that both tokenizers cut off as pieces.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Chunks that are cut here: printable ASCII and letters of Latin scripts, after no space, one space or a line break.
_PLAIN = re.compile(f"[ \n]?[!-~{_LETTERS}]+")
_LETTER_RUN = re.compile(f"[{_LETTERS}]+").fullmatch
_BYTE_PIECE = re.compile(f"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|\n")
_WORD_PIECE = re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^ \n0-9{_LETTERS}]+")
#: The letters that byte-level models write for bytes: printable ones stand for themselves, others follow from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTER = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SELF}))}

_SPACE_LETTER, _BREAK_LETTER = chr(_BYTE_LETTER[0x20]), chr(_BYTE_LETTER[0x0A])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Ids of chunks as bytes; computed when first asked for."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        ids = self.compute(key)
        if len(key) <= CACHE_CHARS:
            self[key] = ids
        return ids


class _SpacedIds(dict):
    """Ids of words after a space.  Most new ones are Latin letters, maybe before a mark, and need no search for pieces."""

    def __init__(self, pieces: _Ids, compute) -> None:
        super().__init__()
        self.pieces, self.compute = pieces, compute

    def __missing__(self, word: str) -> bytes:
        mark = word[-1:] if word[-1:] in (".", ",") else ""
        letters = word[:-1] if mark else word
        if not letters.isalpha() or not (letters.isascii() or _LETTER_RUN(letters)):
            ids = self.compute(word)
        elif mark:
            ids = self[letters] + self.pieces[mark]
        else:
            ids = self.pieces.compute(" " + word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class CachedEncoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit bytes.

    drops_space: the tokenizer lower-cases and forgets white space; otherwise it is byte-level and keeps all.
    """

    def __init__(self, path: str, drops_space: bool, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tok = path, Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.tok.get_added_tokens_decoder().values()})
        self.marks = {a[0] for a in self.added} | {a[0].upper() for a in self.added}
        self.model = self.tok.model
        self.drops_space, self.limit = drops_space, cache_words
        self.width = 4 if self.tok.get_vocab_size() > 1 << 16 else 2
        self.find = (_WORD_PIECE if drops_space else _BYTE_PIECE).findall
        self.chunks, self.pieces = _Ids(self._chunk), _Ids(self._piece)
        self.spaced = _SpacedIds(self.pieces, self._spaced)

    def _cut(self, text: str) -> list[str]:
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        return [text] if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def _spaced(self, word: str) -> bytes:
        return self._chunk(word if word[:1] in ("", "\n") else " " + word)

    def _adds(self, text: str) -> bool:
        """Whether an added token's string may stand in a text; the tokenizer finds it before it cuts words."""
        if not any(m in text for m in self.marks):
            return False
        lower = text.lower()
        return any(a in lower for a in self.added)

    def _spaces(self, text: str) -> bool:
        """Whether all of a text is words between single spaces and line breaks, which stand alone after a space."""
        return not (self.drops_space or text[:1] in _BREAKS or text[-1] in _BREAKS or any(b in text for b in _DOUBLE))

    def _ids(self, text: str) -> bytes:
        """Words between single spaces and line breaks need no search for chunks."""
        if self._adds(text):
            return _bytes(self.tok.encode(text, add_special_tokens=False).ids)
        if not self._spaces(text):
            return b"".join(map(self.chunks.__getitem__, self._cut(text)))
        first, *words = text.replace("\n", " \n").split(" ")
        return self.chunks[first] + b"".join(map(self.spaced.__getitem__, words))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            if piece[0] == " ":
                piece = _SPACE_LETTER + piece[1:]
            elif piece[0] == "\n":
                piece = _BREAK_LETTER + piece[1:]
        else:
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTER)
        return _bytes([t.id for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        # Most chunks are an ASCII word, or one and a mark.
        space = not self.drops_space and chunk[:1] == " "
        last = chunk[-1:] if chunk[-1:] in (".", ",") else ""
        word = chunk[space : len(chunk) - len(last)]
        if word.isalpha() and word.isascii():
            ids = self.pieces[word.lower() if self.drops_space else chunk[: len(chunk) - len(last)]]
            return ids + self.pieces[last] if last else ids
        if _PLAIN.fullmatch(chunk):
            pieces = self.find(chunk.lower() if self.drops_space else chunk)
            return b"".join([self.pieces[p] for p in pieces])
        return _bytes(self.tok.encode(chunk, add_special_tokens=False).ids)

    def _bound(self) -> None:
        for cache in (self.chunks, self.spaced, self.pieces):
            if len(cache) > self.limit:
                cache.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        self._bound()
        return [self._ids(t) for t in texts]

    def encode_flat(self, texts: list[str], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by those of ``end``, and their number for each text.

        Ids have as few bytes as the vocabulary needs, 2 or 4.  Arrow cuts the texts and finds their different words,
        each of which is looked up once; numpy puts the words' ids side by side.  A text's first word has no space
        before it, and a text that isn't words between single spaces counts as one such word.
        """
        self._bound()
        if not texts:
            return np.zeros(0, f"<u{self.width}"), np.zeros(0, np.int64)
        spaced = [not self._adds(t) and self._spaces(t) for t in texts]
        cut = pc.replace_substring(pa.array([t if s else "" for t, s in zip(texts, spaced, strict=True)], pa.large_string()), "\n", " \n")
        cut = pc.split_pattern(cut, " ")
        begin, words = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        del cut
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        numbers = np.asarray(words.indices).copy()
        firsts = [names[i] for i in numbers[begin[:-1]]]
        numbers[begin[:-1]] = len(names) + np.arange(len(texts))
        numbers = np.insert(numbers, begin[1:], len(names) + len(texts))
        del words
        found = list(map(self.spaced.__getitem__, names))
        found += [self.chunks[f] if s else self._ids(t) for t, s, f in zip(texts, spaced, firsts, strict=True)]
        found.append(_bytes(end))
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4").astype(f"<u{self.width}")
        starts, ends = np.cumsum(lens) - lens, np.cumsum(lens[numbers])
        sizes = np.diff(ends[begin[1:] + np.arange(len(texts))], prepend=0)
        out = np.empty(ends[-1], ids.dtype)
        for a in range(0, len(numbers), WORDS_AT_ONCE):
            part = numbers[a : a + WORDS_AT_ONCE]
            n, to = lens[part], ends[a : a + WORDS_AT_ONCE]
            first = to[0] - n[0]
            out[first : to[-1]] = ids[np.repeat(starts[part] - to + n, n) + np.arange(first, to[-1])]
        return out, sizes

    def encode_narrow(self, texts: list[str]) -> tuple[list[bytes], int]:
        """The ids of each text as bytes, in as few each as the vocabulary needs, and that number."""
        ids, sizes = self.encode_flat(texts, [])
        ends = (np.cumsum(sizes) * self.width).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], self.width


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool, cache_words: int = CACHE_WORDS) -> CachedEncoder:
    """One encoder for each tokenizer in a worker process, so that later tasks find the words of earlier ones."""
    return CachedEncoder(path, drops_space, cache_words)


def forget() -> None:
    """Give the memory of remembered words back; a worker that turns to another operator calls it."""
    encoder.cache_clear()


def give_back() -> None:
    """Return freed memory to the system, as the worker process lives on while other stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function over a task's batches that gives its memory back at the end."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
