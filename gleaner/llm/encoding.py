"""Text to token ids with the tokenizers library, each distinct short piece of text encoded once per worker.

Texts are cut beside single white-space characters, and before a stop or comma behind an ASCII letter or digit: places
where the vocabularies used here always begin a token, so that the ids are those of the whole text. Pieces of up to 16
bytes are looked up by their bytes in a table; the library encodes what is not in it. Texts with control characters or
white space beyond ASCII, where such places are uncertain, or with the string of a special token are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

SLOTS, FULL = 1 << 20, 600_000  # places of the table, and pieces it takes before it stops to learn
SPACE, BREAK, ALNUM, STOP, SEPARATOR, OTHER = 1, 2, 3, 4, 5, 0
KIND = np.zeros(256, np.uint8)
for kind, codes in ((SPACE, [32]), (BREAK, [9, 10, 11, 12, 13]), (STOP, [44, 46]), (SEPARATOR, [0])):
    KIND[codes] = kind
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = ALNUM
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
UNCERTAIN = re.compile("[\\x00\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


class PieceTable:
    """Pieces of up to 16 bytes, kept as two numbers, with their ids: open addressing in arrays."""

    def __init__(self):
        self.low, self.high, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.begin, self.length, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32), 1

    @staticmethod
    def slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(44)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is not known."""
        slot = self.slot(low, high)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            here = slot[open_]
            out[open_] = self.at[here]
            open_ = open_[(out[open_] >= 0) & ((self.low[here] != low[open_]) | (self.high[here] != high[open_]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = self.slot(low, high), np.arange(len(low))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = first[self.at[slot[left[first]]] < 0]
            placed = left[first]
            self.low[slot[placed]], self.high[slot[placed]], self.at[slot[placed]] = low[placed], high[placed], numbers[placed]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) % SLOTS


class PieceEncoder:
    """Encodes lists of texts to arrays of ids.

    ``spaces`` tells whether a space belongs to the token behind it (byte-level BPE) or is dropped with all white space.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces, self.table = spaces, PieceTable()
        # texts with the string of an added token are left to the library as they are
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncertain = re.compile("|".join([UNCERTAIN.pattern, *added]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for pieces, from the library."""
        ids, length = [], []
        for at in range(0, len(pieces), 4096):
            for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[at:at + 4096]], add_special_tokens=False):
                ids.extend(e.ids)
                length.append(len(e.ids))
        return np.array(ids, np.uint32), np.array(length, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(t) and not self.uncertain.search(t) for t in texts]
        out: list = [None if p else self.whole(t) if t else np.zeros(0, np.uint32) for p, t in zip(plain, texts)]
        if any(plain):
            which = [i for i, p in enumerate(plain) if p]
            for i, ids in zip(which, self.encode_plain([texts[i] for i in which])):
                out[i] = ids
        return out

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        if not self.spaces:
            texts = [t.lower() if t.isascii() else t for t in texts]
        data = b"\0" + "\0".join(texts).encode() + bytes(17)
        buf = np.frombuffer(data, np.uint8)[:len(data) - 16]
        kind = KIND[buf]
        blank = (kind == SPACE) | (kind == BREAK)
        edge = blank | (kind == SEPARATOR)
        cut = np.zeros(len(buf), bool)
        cut[1:] = (kind[1:] == STOP) & (kind[:-1] == ALNUM)
        if self.spaces:
            alone = blank[1:-1] & ~edge[:-2] & ~edge[2:]
            cut[1:-1] |= alone
            cut[2:] |= alone & (kind[1:-1] == BREAK)
            skipped = kind == SEPARATOR
        else:
            skipped = edge
        cut |= skipped
        cut[1:] |= skipped[:-1]
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(buf))
        keep = ~skipped[start]
        doc = np.cumsum(kind[start] == SEPARATOR)[keep] - 1
        start, size = start[keep], size[keep]
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = words[start] & LOW_BYTES[np.minimum(size, 8)]
        high = words[start + 8] & LOW_BYTES[np.clip(size - 8, 0, 8)]
        number = np.where(size <= 16, self.table.find(low, high), -1)
        table = self.table
        begin, length, pool = table.begin[number], table.length[number], table.ids
        new = np.flatnonzero(number < 0)
        if len(new):
            pieces: dict[bytes, int] = {}
            key = [pieces.setdefault(data[a:a + n], len(pieces)) for a, n in zip(start[new].tolist(), size[new].tolist())]
            ids, n_ids = self.ask(list(pieces))
            key = np.array(key)
            begin[new], length[new] = (np.cumsum(n_ids) - n_ids)[key] + len(pool), n_ids[key]
            pool = np.concatenate((pool, ids))
            if table.used < FULL:
                table.begin = np.concatenate((table.begin, np.cumsum(n_ids) - n_ids + len(table.ids)))
                table.length, table.ids = np.concatenate((table.length, n_ids)), pool
                _, first = np.unique(key, return_index=True)
                short = size[new[first]] <= 16
                at = new[first[short]]
                table.add(low[at], high[at], (table.used + np.arange(len(pieces))[short]).astype(np.int32))
                table.used += len(pieces)
        ends = np.cumsum(length)
        flat = pool[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.searchsorted(doc, np.arange(len(texts) + 1))]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@cache
def encoder(path: str, spaces: bool) -> PieceEncoder:
    """One per worker process and vocabulary."""
    return PieceEncoder(path, spaces)


def chunks(texts: list, size: int = 1 << 20):
    """Ranges of ``texts`` with about ``size`` characters each."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
