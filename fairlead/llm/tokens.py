"""Token ids of whole texts by the ``tokenizers`` library, with a memory of segments.

Byte-level BPE splits text into pieces before it merges, and some points always
end a piece: before a space that a visible character follows, between a letter
and a punctuation mark, and around a lone line feed between a mark or letter and
a letter.  An added token such as ``<|endoftext|>`` is a segment of its own, and
what lies beside it is cut like the begin and end of a text.  A text's ids are
the ids of its segments cut there, one after the other.  A worker encodes each distinct segment once by the library and keeps it
in a hash table of numpy arrays; a hit counts only when the segment's bytes are
equal, so the memory changes nothing but the speed.  It is emptied at
``MEMORY`` segments or ``POOL`` bytes.  Tests hold the ids against encoding whole
texts at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from fairlead.llm.common import KEPT, _byte_codes, _powers, mix64, text_buffers

END_ID = 2
MEMORY = 700_000
POOL = 32 << 20
_SLOT_BITS = 21

_SPACE, _LINE = 0x20, 0x0A
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: Bytes that begin a visible character for certain; those of C2, E1, E2 and E3 can begin white space.
_BEGINS = _VISIBLE.copy()
_BEGINS[0xC3:0xE1] = _BEGINS[0xE4:0xF5] = True
#: Marks that are neither letters, digits, white space nor apostrophes.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?*%$#&|()-/+=<>@_\"[]{}~^`\\"]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def occurrences(tokens: re.Pattern[bytes], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(begin, end) of the added tokens inside texts, from left to right."""
    raw, found, at = data.tobytes(), [], 0
    while hit := tokens.search(raw, at):
        text = np.searchsorted(offsets, hit.start(), side="right")
        if hit.end() <= offsets[text]:
            found.append(hit.span())
            at = hit.end()
        else:  # the end of one text and the begin of the next
            at = hit.start() + 1
    return np.array(found, np.int64).reshape(-1, 2)


def segments(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where segments begin; every non-empty text begins one, and each range of ``whole`` is one."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    inner = np.ones(n + 1, bool)  # false where a text or a whole range begins or ends: no rule looks over that point
    inner[offsets] = False
    if whole is not None:
        inner[whole] = False
    if n > 1:
        here, then = data[:-1], data[1:]
        cut[:-2] |= (here == _SPACE) & _BEGINS[then] & inner[1:-1]
        cut[1:-1] |= _LETTER[here] & _MARK[then] & inner[1:-1]
    if n > 2:
        alone = _VISIBLE[data[:-2]] & (data[1:-1] == _LINE) & _LETTER[data[2:]] & inner[1:-2] & inner[2:-1]
        cut[1:-2] |= alone
        cut[2:-1] |= alone
    if whole is not None:
        for begin, end in whole.tolist():
            cut[begin:end] = False
        cut[whole] = True
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of texts by the library's defaults, with no special tokens put around them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        added = self._model.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized or " " in t.content for t in added):
            raise ValueError("an added token depends on the text beside it")
        contents = sorted((t.content.encode() for t in added), key=len, reverse=True)  # the longest wins, as in the library
        self._added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        vocabulary = self._model.get_vocab(with_added_tokens=True)
        self._spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self._spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._clear()

    def _clear(self) -> None:
        self._slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self._count = self._ids_end = self._bytes_end = 0
        self._hash = np.zeros(1 << 16, np.uint64)
        self._place = np.zeros((1 << 16, 4), np.int32)  # first id, ids, first byte, bytes
        self._ids = np.zeros(1 << 18, np.uint32)
        self._bytes = np.zeros(1 << 19, np.uint8)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.zeros((max(size, len(array) * 3 // 2), *array.shape[1:]), array.dtype)
        grown[: len(array)] = array
        return grown

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 for unknown ones."""
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = self._slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self._hash[found] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOT_BITS) - 1)
            found[open_] = self._slots[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self._hash[found[open_]] != hashes[open_])]
        return found

    def _add(self, hashes: np.ndarray) -> None:
        """Give the last entries' hashes their slots."""
        entry = np.arange(self._count - len(hashes), self._count, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(entry):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = entry[free]
            left = self._slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & ((1 << _SLOT_BITS) - 1)

    def _encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts for segments, by the library."""
        spaces = np.concatenate([[0], np.cumsum(data == _SPACE)])
        lone = (data[start] == _SPACE) & (size > 1) & (spaces[start + size] - spaces[start] == 1)
        lone &= _BEGINS[data[np.minimum(start + 1, len(data) - 1)]]
        raw = data.tobytes()
        counts, parts = np.zeros(len(start), np.int64), [None] * len(start)
        at = np.flatnonzero(lone)
        if len(at):  # each begins with its only space, so their text can be encoded at once and cut again
            text = b"".join([raw[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]).decode()
            ids = np.array(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            begins = np.flatnonzero(self._spaced[ids])
            if len(begins) != len(at):
                raise ValueError("the tokenizer does not begin an id at each space")
            counts[at] = np.diff(np.append(begins, len(ids)))
            for k, part in zip(at.tolist(), np.split(ids, begins[1:]), strict=True):
                parts[k] = part
        rest = np.flatnonzero(~lone)
        texts = [raw[a : a + n].decode() for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
        for k, e in zip(rest.tolist(), self._model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            parts[k] = np.array(e.ids, np.uint32)
            counts[k] = len(parts[k])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), counts

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        ids, counts = self._encoded(data, start, size)
        n, m = len(start), int(size.sum())
        self._hash = self._room(self._hash, self._count + n)
        self._place = self._room(self._place, self._count + n)
        self._ids = self._room(self._ids, self._ids_end + len(ids))
        self._bytes = self._room(self._bytes, self._bytes_end + m)
        here = slice(self._count, self._count + n)
        first = np.cumsum(size) - size
        self._hash[here] = hashes
        self._place[here, 0] = self._ids_end + np.cumsum(counts) - counts
        self._place[here, 1] = counts
        self._place[here, 2] = self._bytes_end + first
        self._place[here, 3] = size
        self._ids[self._ids_end : self._ids_end + len(ids)] = ids
        self._bytes[self._bytes_end : self._bytes_end + m] = data[np.repeat(start - first, size) + np.arange(m)]
        self._count, self._ids_end, self._bytes_end = self._count + n, self._ids_end + len(ids), self._bytes_end + m
        self._add(hashes)

    def encode_buffers(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and each text's range; ``end`` is appended to each text."""
        if self._count > MEMORY or max(self._ids_end, self._bytes_end) > POOL:
            self._clear()
        start = segments(data, offsets, None if self._added is None else occurrences(self._added, data, offsets))
        n = len(data)
        size = np.diff(np.append(start, n))
        if len(start):
            at = np.arange(n) - np.repeat(start, size)
            value = _byte_codes(False)[data] * _powers(int(size.max()))[at]
            hashes = mix64(np.add.reduceat(value, start) + size.astype(np.uint64))
            entry = self._find(hashes)
            new = np.flatnonzero(entry < 0)
            if len(new):
                _, one = np.unique(hashes[new], return_index=True)
                one = new[one]
                self._learn(data, start[one], size[one], hashes[one])
                entry[new] = self._find(hashes[new])
            first, counts, byte, length = self._place[entry].T
            same = length == size
            if same.all():
                same = np.logical_and.reduceat(self._bytes[np.repeat(byte - start, size) + np.arange(n)] == data, start)
            if not same.all():  # another segment with this hash: nothing of this run is taken from memory
                ids, counts = self._encoded(data, start, size)
            else:
                before = np.cumsum(counts) - counts
                ids = self._ids[np.repeat(first - before, counts) + np.arange(int(counts.sum()))]
            edge = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, offsets)]
        else:
            ids, edge = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if end is not None:
            ids = np.insert(ids, edge[1:], end)
            edge = edge + np.arange(len(edge))
        return ids.astype("<u4", copy=False), edge

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        ids, edge = self.encode_buffers(*text_buffers(pa.array(list(texts), pa.string())))
        return [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """This worker's encoder; it outlives a task, until one that needs none clears ``KEPT``."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]
