"""Encoding with a public tokenizer, each distinct word once.

No piece of either pre-tokenizer goes on from a visible character into white space, so a text's ids are those of its
segments, white space and the word after it, one after the other. Segments are offsets into the text buffer: a block's
are dictionary-encoded by Arrow, and only distinct ones reach Python. A worker encodes a segment with the tokenizers
library when it first meets it and looks it up from then on. New segments are encoded together and told apart by the
vocabulary: a byte-level token begins with the blank, a word-end token closes a piece. Segments for which that isn't
certain, and all if a count doesn't come out, are encoded one by one. A text with white space beyond ASCII, or with the
string of a token that the vocabulary adds to its pieces (as ``<|endoftext|>``), is one segment. Long segments are not
stored; the store is emptied when it is full.

ids are those of the library's ``encode(text, add_special_tokens=False)``, which knows added tokens in a text. With
``literal_specials`` such a string is encoded as any other text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quern.llm.words import scan

#: Segments that a worker stores (about 200 bytes each), the longest of them, and how many are joined.
STORE, LONGEST, JOINED = 600_000, 48, 1000
#: Bytes of text that are best encoded at once.
BLOCK = 4 << 20
#: Segments whose normal form and pieces are certain; pieces as the word-level pre-tokenizer has them (a fixed value).
_LATIN = re.compile(r"[!-~\xa1-\xac\xae-\u024f]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Bytes where white space beyond [\\x20\\x09-\\x0D], or what some take for it, may begin."""
    at = np.flatnonzero(_LEAD[data])
    a, b = data[at], data[np.minimum(at + 1, len(data) - 1)]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    return at[odd | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))]


class _Numbers(dict):
    """Numbers keys in order of their first lookup and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, key: str) -> int:
        k = self[key] = self.next
        self.next += 1
        self.new.append(key)
        return k


class WordStore:
    """ids of whole texts; blank_leads: does a word carry the blank before it (byte-level) or is it dropped?"""

    def __init__(self, path: str, blank_leads: bool, literal_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        self.added = [] if literal_specials else sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.blank_leads = blank_leads
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)  # of tokens that begin, or end, a segment's piece
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if blank_leads else token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbers()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.size = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _segments(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts as one array, and the number of each text's."""
        w = scan(text)
        off = w.offsets
        ends = w.end
        odd = _odd_spaces(w.data)
        whole = self._with_added(text)
        if len(odd):
            whole[np.searchsorted(off, odd, "right") - 1] = True
        if whole.any():
            ends = ends[~whole[w.row]]
        cut = np.zeros(len(w.data) + 1, bool)
        cut[ends] = cut[off] = True
        cuts = np.flatnonzero(cut)
        kind = pa.int32() if len(w.data) < 2**31 else pa.int64()
        make = pa.StringArray if kind == pa.int32() else pa.LargeStringArray
        segments = make.from_buffers(len(cuts) - 1, pa.array(cuts, kind).buffers()[1], pa.py_buffer(np.ascontiguousarray(w.data)))
        return segments, np.diff(np.searchsorted(cuts, off))

    def _with_added(self, text: pa.Array) -> np.ndarray:
        """Texts that hold an added token; upper and lower case count alike, as a text's normal form may be lower case."""
        out = np.zeros(len(text), bool)
        for token in self.added:
            out |= pc.fill_null(pc.match_substring(text, token, ignore_case=True), False).to_numpy(zero_copy_only=False)
        return out

    def _pieces(self, key: str) -> int:
        """How many edges a segment's ids have when it is joined with others; 0 if that isn't certain."""
        if len(key) < 2 or key[0] != " " or key[1].isspace():
            return 0
        if self.blank_leads:
            return int(" " not in key[1:])
        word = key[1:]
        return (1 if word.isalpha() else len(_PIECES.findall(word.lower()))) if _LATIN.fullmatch(word) else 0

    def _encoded(self, keys: list[str]) -> Iterator[list[int]]:
        yield from (e.ids for e in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False))

    def _joined(self, keys: list[str], pieces: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """ids of keys, and the number of each key's."""
        ids, sizes = [], []
        parts = [(keys[i : i + JOINED], np.cumsum(pieces[i : i + JOINED])) for i in range(0, len(keys), JOINED)]
        for (k, upto), e in zip(parts, self.tokenizer.encode_batch_fast(["".join(k) for k, _ in parts], add_special_tokens=False)):
            x = np.array(e.ids, np.uint32)
            edges = np.flatnonzero(self.edge[x])
            if len(edges) != upto[-1] or not len(x) or (not self.blank_leads and edges[-1] != len(x) - 1) or (self.blank_leads and edges[0]):
                found = list(self._encoded(k))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
                sizes.append(np.fromiter(map(len, found), np.int64))
                continue
            ends = np.append(edges[1:], len(x)) if self.blank_leads else edges[upto - 1] + 1
            ids.append(x)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _fill(self, new: list[str], first: int) -> None:
        """Encode new segments and store their ids under numbers from first on."""
        n = len(new)
        while first + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        pieces = [self._pieces(k) for k in new]
        sure = np.array(pieces) > 0
        for where in (np.flatnonzero(sure), np.flatnonzero(~sure)):
            if not len(where):
                continue
            keys = [new[i] for i in where]
            if sure[where[0]]:
                ids, sizes = self._joined(keys, [pieces[i] for i in where])
            else:
                found = list(self._encoded(keys))
                ids, sizes = np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.size[first + where] = sizes
            self.begin[first + where] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; a null text has none."""
        if len(self.at) > STORE or self.used > 16 * STORE:
            self._clear()
        segments, counts = self._segments(texts)
        coded = segments.dictionary_encode()
        at = self.at
        first = at.next
        number = np.fromiter(map(at.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        new, at.new = at.new, []
        if new:
            self._fill(new, first)
            for x in new:
                if len(x) > LONGEST:
                    del at[x]
        which = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else number
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[which] - ends + sizes, sizes) + np.arange(total)] if total else np.empty(0, np.uint32)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


@lru_cache(4)
def store(path: str, blank_leads: bool, literal_specials: bool = False) -> WordStore:
    """One for each tokenizer in a worker process, kept between tasks."""
    return WordStore(path, blank_leads, literal_specials)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
