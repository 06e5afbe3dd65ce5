"""Byte-level BPE ids by the tokenizers library, each distinct chunk once.

A text is cut where no match of the pre-tokenizer's pattern can cross: before
white space that follows something else, and before ASCII punctuation that
follows an ASCII letter or digit. The ids of the chunks in order are then the
ids of the text, and a chunk met before need not be encoded again. Finding and
looking up chunks is numpy work on bytes.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from chatterlens.llm import textbits

#: Bytes before which a text may be cut: ASCII white space, and punctuation
#: other than the apostrophe, which starts contractions.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places inside the buffer before which it may be cut."""
    before, here = buf[:-1], buf[1:]
    # The last byte of a character that may be white space beyond ASCII: two
    # bytes from C2, three from E1 to E3. Others that begin so lose a cut only.
    doubt = np.zeros(len(before), dtype=bool)
    doubt[1:] |= buf[:-2] == 0xC2
    doubt[2:] |= (buf[:-3] >= 0xE1) & (buf[:-3] <= 0xE3)
    white = textbits.SPACE[here] & ~textbits.SPACE[before] & ~(doubt & (before >= 0x80))
    return np.flatnonzero(white | (PUNCTUATION[here] & ALNUM[before])) + 1


class Encoder:
    """Ids of texts; the store starts anew once it holds ``most`` chunks, so a
    worker's memory is bounded by that and the chunks of one call."""

    def __init__(self, path: str, most: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # Chunks are told apart by a hash that no text can be written against.
        self.seed = int.from_bytes(os.urandom(8))
        # In a byte-level vocabulary every character of a token stands for one byte.
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.filled = 0

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has. Chunks of
        a blank and something else are encoded as one text, since the places
        between them are cuts too."""
        long = np.array([len(c) for c in chunks], dtype=np.int64)
        buf = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        end = np.cumsum(long)
        begin = end - long
        second = buf[np.minimum(begin + 1, len(buf) - 1)]
        plain = (long > 1) & (buf[begin] == 32) & (second > 32) & (buf[end - 1] < 0x80)
        made, size = np.zeros(0, dtype=np.uint32), np.zeros(len(chunks), dtype=np.int64)
        if plain.any():
            text = buf[np.repeat(plain, long)].tobytes().decode("utf-8", "replace")
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.cumsum(self.width[flat])
            want = np.cumsum(long[plain])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                made, size[plain] = flat, np.diff(at, prepend=-1)
            else:
                plain[:] = False
        rest = np.flatnonzero(~plain).tolist()
        if not rest:
            return made, size
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(
            [chunks[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)]
        size[rest] = [len(x) for x in lists]
        ids = np.zeros(int(size.sum()), dtype=np.uint32)
        own = np.repeat(plain, size)
        ids[own] = made
        ids[~own] = np.fromiter(chain.from_iterable(lists), dtype=np.uint32)
        return ids, size

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        fresh, size = self._encode(chunks)
        while self.filled + len(fresh) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
        self.ids[self.filled: self.filled + len(fresh)] = fresh
        first = self.filled + np.cumsum(size) - size
        self.filled += len(fresh)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.insert(self.first, place, first)
        self.size = np.insert(self.size, place, size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text begins (one entry more)."""
        if any(a in t for a in self.added for t in texts):
            return self._encode_apart(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        data = b"".join(texts)
        if not data:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        buf = np.frombuffer(data, dtype=np.uint8)
        if len(self.keys) > self.most:
            self._clear()
        start = np.sort(np.concatenate([cuts(buf), bounds[:-1][lengths > 0]]))
        start = start[np.concatenate([[True], start[1:] != start[:-1]])]
        chunks = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf))), pa.py_buffer(data)]).dictionary_encode()
        found = chunks.dictionary.to_pylist()
        keys = textbits.digests(found, len(found), self.seed)
        order = np.argsort(keys)
        keys, rank = keys[order], np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        back = rank[chunks.indices.to_numpy()]
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], [found[i] for i in order[new].tolist()])
            place = np.searchsorted(self.keys, keys)
        begin, size = self.first[place][back], self.size[place][back]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, bounds)]


    def _encode_apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with texts that hold an added token's string left whole."""
        parts, run = [], []
        for text in [*texts, None]:
            if text is not None and not any(a in text for a in self.added):
                run.append(text)
                continue
            if run:
                ids, at = self.encode(run)
                parts += np.split(ids, at[1:-1])
                run = []
            if text is not None:
                made = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
                parts.append(np.array(made[0].ids, dtype=np.uint32))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_kept: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 3_000_000) -> Encoder:
    """One encoder per Python worker, vocabulary and size of its store."""
    if (path, most) not in _kept:
        _kept[path, most] = Encoder(path, most)
    return _kept[path, most]
