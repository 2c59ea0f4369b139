"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

The vocabulary's pre-tokenizer never joins what stands on the two sides of a space character that
has a visible character after it: it either ends a run of spaces there or starts a word with it.
Nor does it join an ASCII letter with an ASCII punctuation mark after it. So a text may be cut
before each such space and each such mark, and the pieces encoded apart. Pieces are found in numpy
over Arrow buffers and their ids kept from batch to batch. A text with the literal of a special
token is encoded in one go, and so is every text if the vocabulary's file states another
pre-tokenizer, a normalizer or a model that takes words otherwise (cuts_hold).
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tracewell.llm.common import buffers, row_chunks

END_ID = 0
ENCODE_BYTES = 4 << 20
#: Pieces whose ids a task keeps; beyond that it starts anew.
KEPT_PIECES = 800_000
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that start a visible character for certain: printable ASCII, and lead bytes of blocks that hold no space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE1] = True
_VISIBLE[0xE4:0xF5] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[ord("0") : ord("9") + 1] = False
_MARK[_LETTER] = False


#: A space or none, then letters: ASCII ones and those of Latin-1.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible in Latin-1, else the next from U+0100 on."""
    hidden = [b for b in range(256) if b <= 0x20 or 0x7F <= b <= 0xA0 or b == 0xAD]
    return {b: chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


def cuts_hold(stated: dict) -> bool:
    """Whether a vocabulary's file states the byte-level pre-tokenizer for which the cuts are right, and plain byte-pair encoding."""
    before, model = stated.get("pre_tokenizer") or {}, stated.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    return bool(plain and stated.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not any(odd) and not stated.get("truncation") and not stated.get("padding"))


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.in_pieces = cuts_hold(json.loads(self.tokenizer.to_str()))
        self.letters = byte_characters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(KEPT_PIECES * 2, np.int64)
        self.sizes = np.zeros(KEPT_PIECES * 2, np.int32)
        self.used = 0

    def _learn(self, pieces: list[bytes]) -> None:
        """Words of letters go to the vocabulary's model as they are; all else in one call with pre-tokenizing."""
        words, rest = [], []
        for p in pieces:
            (words if _WORD.fullmatch(p) else rest).append(p)
        model = self.tokenizer.model
        lists = [[t.id for t in model.tokenize(p.decode("latin-1").translate(self.letters))] for p in words]
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        if rest:
            encoding = self.tokenizer.encode([p.decode() for p in rest], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate((ids, np.array(encoding.ids, np.uint32)))
            # word_ids tells which piece an id belongs to.
            sizes = np.concatenate((sizes, np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(rest))))
        a, b = len(self.known), len(self.known) + len(pieces)
        if b > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, b * 2), np.resize(self.sizes, b * 2)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[a:b] = sizes
        self.starts[a:b] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(words + rest, range(a, b)))
        self.used += len(ids)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start, the rows' own starts among them."""
        cut = np.zeros(len(data) + 1, bool)
        cut[: len(data) - 1] = _ASCII_SPACE[data[:-1]] & _VISIBLE[data[1:]]
        cut[1 : len(data)] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[offsets] = True
        return np.flatnonzero(cut)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and each row's first position (rows + 1 numbers)."""
        raw = data.tobytes()
        if not self.in_pieces or any(s.encode() in raw for s in self.special):
            parts = [self.whole(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > KEPT_PIECES:
            self.forget()
        cuts = self._cuts(data, offsets)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.known]
        if fresh:
            self._learn(fresh)
        numbers = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.sizes[numbers].astype(np.int64)
        upto = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (upto - sizes), sizes) + np.arange(upto[-1])
        first = np.concatenate(([0], upto))[np.searchsorted(cuts, offsets)]
        return self.ids[at], first

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each chunk of rows a to b: the rows' ids with END_ID after each row, and their positions."""
        data, offsets = buffers(column)
        for a, b in row_chunks(offsets, ENCODE_BYTES):
            ids, first = self.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ended = np.insert(ids, first[1:], END_ID)
            yield a, b, ended, first + np.arange(len(first))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its pieces from task to task unless the task forgets them."""
    return Encoder(path)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
