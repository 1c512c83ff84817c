"""Texts to token ids with the tokenizers library, a batch of texts at a time.

Byte-level BPE never merges across the start of a word: its splitting pattern lets a single space, or a single line
break, between other characters begin a new piece, whatever stands before it, and parts letters from a dot or comma
behind them. So texts are cut there, in numpy over the bytes of the batch; each distinct piece is encoded once by the
library, and the ids of a text are the joined ids of its pieces. Texts that hold a run of white space or a special
token's string are encoded by the library in one call. A piece of up to 16 bytes is found in a table by these bytes and
its length, which are compared whole; longer ones are found in a dictionary of their bytes. So no piece is taken for another.
"""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from specgate.llm.shingles import SHORT, bytes_of, first_bytes, mix64

#: Slots for pieces in a worker's table, pieces and ids that it holds; a full one starts anew. They change the speed only.
SLOT_BITS, PIECES, POOL_IDS = 22, 1 << 20, 1 << 23

#: Bytes of text that a worker encodes at once.
BATCH_BYTES = 2 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.isin(np.arange(256), [ord("."), ord(",")])
_CUT = np.isin(np.arange(256), [32, 10])
#: White space, as one byte, or first bytes of longer white space (and of other characters).
_MAY_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slots = np.zeros(1 << SLOT_BITS, "i4")
        self._reset()

    def _reset(self) -> None:
        self.slots[:] = -1
        self.starts, self.counts, self.n = np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i4"), 0
        self.keys = np.zeros((3, 1 << 16), "u8")  # first and second eight bytes, length; of long pieces no such length
        self.pool, self.used = np.zeros(1 << 20, "u4"), 0
        self.long: dict[bytes, int] = {}

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The two slots of each piece."""
        hashes = mix64(low ^ mix64(high + size * np.uint64(0xD6E8FEB86659FD93)))
        return [(hashes >> np.uint64(shift) & np.uint64((1 << SLOT_BITS) - 1)).astype("i8") for shift in (64 - SLOT_BITS, 8)]

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of short pieces, -1 where unknown."""
        out = np.full(len(low), -1, "i4")
        rest = np.arange(len(low))
        for slot in self._slots(low, high, size):
            entry = self.slots[slot[rest]]
            hit = (entry >= 0) & (self.keys[0, entry] == low[rest]) & (self.keys[1, entry] == high[rest]) & (self.keys[2, entry] == size[rest])
            out[rest[hit]] = entry[hit]
            rest = rest[~hit]
        return out

    def _learn(self, texts: list[str]) -> np.ndarray:
        """New entries with the ids of these pieces."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), "i4", len(ids))
        total, n = int(counts.sum()), self.n
        while n + len(ids) > len(self.starts):
            self.starts, self.counts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.counts))
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), "u4", total)
        self.starts[n : n + len(ids)] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + len(ids)] = counts
        self.used, self.n = self.used + total, n + len(ids)
        return np.arange(n, self.n, dtype="i4")

    def _short(self, buffer: bytes, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of pieces of up to 16 bytes."""
        size = (ends - at).astype("u8")
        low, high = first_bytes(data, at, ends)
        entry = self._find(low, high, size)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            order = missing[np.lexsort((size[missing], high[missing], low[missing]))]
            new = np.concatenate([[True], np.diff(low[order]).astype(bool) | np.diff(high[order]).astype(bool) | np.diff(size[order]).astype(bool)])
            own = order[new]
            added = self._learn([buffer[a:b].decode() for a, b in zip(at[own].tolist(), ends[own].tolist(), strict=True)])
            self.keys[:, added] = low[own], high[own], size[own]
            first, second = self._slots(low[own], high[own], size[own])
            self.slots[np.where((self.slots[first] < 0) | (self.slots[second] >= 0), first, second)] = added
            entry[order] = added[np.cumsum(new) - 1]
        return entry

    def _long(self, buffer: bytes, at: np.ndarray, ends: np.ndarray) -> list[int]:
        """Entries of longer pieces."""
        pieces = [buffer[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        new = list({p for p in pieces if p not in self.long})
        if new:
            self.long.update(zip(new, self._learn([p.decode() for p in new]).tolist(), strict=True))
        return [self.long[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, unsigned 32-bit, and the offset of each text's first one; null is empty."""
        data, offsets = bytes_of(texts)
        n, buffer = len(data), data.tobytes()
        if self.used > POOL_IDS or self.n > PIECES:
            self._reset()
        cut = _CUT[data]
        last = np.zeros(n + 1, bool)
        last[offsets] = True
        begin = cut | last[:-1]
        begin[1:] |= (data[:-1] == 10) & ~_MAY_BLANK[data[1:]]
        behind = np.concatenate([cut[1:], [True]]) | last[1:] if n else cut
        begin[1:] |= (_MARK[data] & behind)[1:] & _LETTER[data[:-1]]
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], n)
        long = np.flatnonzero(ends - at > SHORT)
        short = np.flatnonzero(ends - at <= SHORT)
        entry = np.empty(len(at), "i4")
        entry[short] = self._short(buffer, data, at[short], ends[short])
        entry[long] = self._long(buffer, at[long], ends[long])
        counts = self.counts[entry]
        before = np.concatenate([[0], np.cumsum(counts, dtype="i8")])
        total = int(before[-1])
        ids = self.pool[np.repeat(self.starts[entry] - before[:-1], counts) + np.arange(total)]
        bounds = before[np.searchsorted(at, offsets)]
        odd = self._odd(data, buffer, offsets, np.flatnonzero(cut))
        if not len(odd):
            return ids, bounds
        parts, sizes = [], np.diff(bounds)
        done = 0
        for k in odd:
            own = np.array(self.tokenizer.encode(buffer[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, "u4")
            parts += [ids[done : bounds[k]], own]
            done, sizes[k] = bounds[k + 1], len(own)
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _odd(self, data: np.ndarray, buffer: bytes, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Texts in which white space stands before a space or line break, or a special token's string stands anywhere."""
        row = np.searchsorted(offsets, cuts, "right") - 1
        room = cuts - offsets[row]
        b1, b2, b3 = (np.where(room >= k, data[np.maximum(cuts - k, 0)], 0) for k in (1, 2, 3))
        wide = (b3 == 0xE2) & (((b2 == 0x80) & ((b1 <= 0x8A) | np.isin(b1, (0xA8, 0xA9, 0xAF)))) | ((b2 == 0x81) & (b1 == 0x9F)))
        wide |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
        wide |= (b2 == 0xC2) & np.isin(b1, (0x85, 0xA0))
        odd = set(row[(room >= 1) & (_BLANK[b1] | wide)].tolist())
        for token in self.special:
            place = buffer.find(token)
            while place >= 0:
                odd.add(int(np.searchsorted(offsets, place, "right") - 1))
                place = buffer.find(token, place + 1)
        return np.array(sorted(odd), "i8")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
