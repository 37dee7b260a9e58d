"""Subword ids for whole texts by the tokenizers library, each distinct unit encoded once per worker.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so that encoding the units one by one
gives the ids of the whole text; texts in which other white space than ASCII's could move a cut, or that
hold a special token's string, are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

from .bytetext import SPACE, Slice, byte_table, prefix_hash, span_hash

#: Units that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 1_000_000
CHUNK = 128 << 10

#: White space outside ASCII (Unicode White_Space), as UTF-8.
OTHER_SPACE = re.compile(b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\\|")


#: ASCII letters; punctuation that never joins a letter before it; second bytes of U+00C0-U+00FF letters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[]^_{|}~']] = True
LATIN_SECOND = np.zeros(256, bool)
LATIN_SECOND[0x80:0xC0] = True
LATIN_SECOND[[0x97, 0xB7]] = False


class Encoder:
    """``kind``: "byte" for byte-level BPE (white space belongs to ids), "word" where white space is dropped."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.kind = kind
        self.mark = int(self._whole("|" if kind == "word" else "\n")[0])
        self.clear()

    def clear(self) -> None:
        """Remembered units: two sorted runs of (hash, unit number), the newer one small, and the units' ids."""
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.off = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has), encoded some CHUNK bytes at a time: the tokenizer holds over 100 bytes for each byte of a call."""
        size = np.cumsum([len(u) for u in units])
        cut = np.flatnonzero(np.diff(np.r_[-1, size // CHUNK])).tolist()
        parts = [self._encode_some(units[i:j]) for i, j in zip(cut, [*cut[1:], len(units)], strict=True)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _encode_some(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per unit), from one call for all plain units and one for each odd one."""
        mark = b" | " if self.kind == "word" else b"\n"
        odd = [i for i, u in enumerate(units) if not self._plain(u)]
        skip = set(odd)
        plain = [u for i, u in enumerate(units) if i not in skip]
        parts: list = []
        if plain:
            ids = self._whole((mark.join(plain) + mark).decode("utf-8", "replace"))
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(plain):
                raise RuntimeError("the tokenizer does not keep units apart")
            keep = ids != self.mark
            n = np.diff(np.r_[-1, cut]) - 1
            if not odd:
                return ids[keep], n
            parts = np.split(ids[keep], np.cumsum(n)[:-1])
        it, odd_set = iter(parts), skip
        out = [self._whole(u.decode("utf-8", "replace")) if i in odd_set else next(it) for i, u in enumerate(units)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _plain(self, u: bytes) -> bool:
        """Whether the unit keeps its ids between two marks."""
        if self.kind == "word":
            return b"|" not in u
        return u[0] != 0x20 and not SPACE[u[0]] or (len(u) > 1 and u[0] == 0x20 and not SPACE[u[1]])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Unit numbers of sorted distinct hashes, -1 where new."""
        out = np.full(len(h), -1, np.int64)
        for keys, numbers in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[hit] = numbers[at[hit]]
        return out

    def _add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        (k0, n0), (k1, n1) = self.runs

        def merged(a, b, c, d):
            k, n = np.concatenate([a, c]), np.concatenate([b, d])
            o = np.argsort(k, kind="stable")
            return k[o], n[o]

        k1, n1 = merged(k1, n1, h, numbers)
        if len(k1) > 20_000 + len(k0) // 3:
            (k0, n0), (k1, n1) = merged(k0, n0, k1, n1), (k1[:0], n1[:0])
        self.runs = [(k0, n0), (k1, n1)]

    def _units(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each unit: words with what leads them, cut again where punctuation follows a letter."""
        d, n = s.data, len(s.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = SPACE[d]
        first = np.zeros(n, bool)
        first[s.off[:-1][s.off[:-1] < n]] = True
        before = np.zeros(n, bool)
        before[1:] = space[:-1]
        before &= ~first
        letter = LETTER[d]
        after_letter = np.zeros(n, bool)
        after_letter[1:] = letter[:-1]
        after_letter[2:] |= (d[:-2] == 0xC3) & LATIN_SECOND[d[1:-1]]
        cut = PUNCTUATION[d] & after_letter & ~first
        if self.kind == "word":
            start = ~space & (first | before | cut)
            end = np.zeros(n + 1, bool)
            end[:-1] = (space | first | cut) & True
            end[n] = True
            inside = np.zeros(n + 1, bool)
            inside[1:] = ~space
            return np.flatnonzero(start), np.flatnonzero(end & inside)
        last = np.zeros(n, bool)
        last[s.off[1:][s.off[1:] > 0] - 1] = True
        lead = np.zeros(n, bool)
        lead[:-1] = space[:-1] & ~space[1:]
        lead &= ~last
        glued = np.zeros(n, bool)
        glued[1:] = (lead & (d == 0x20))[:-1]
        # A word starts a unit unless a space leads it; the last white space before a word stands alone or leads it.
        start = first | cut | (~space & before & ~glued) | (space & ~before) | (lead & before)
        at = np.flatnonzero(start)
        return at, np.r_[at[1:], n]

    def slice_ids(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per document) for a slice's whole documents."""
        start, end = self._units(s)
        p = prefix_hash(byte_table(11, self.kind == "word")[s.data])
        h = span_hash(p, start, end)
        distinct, first, where = np.unique(h, return_index=True, return_inverse=True)
        if len(self.off) + len(distinct) > REMEMBERED:
            self.clear()
        known = self._find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = s.data.tobytes()
            ids, n = self._encode([raw[i:j] for i, j in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            known[new] = np.arange(len(self.off) - 1, len(self.off) - 1 + len(new))
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, ids])
            self._add(distinct[new], known[new])
        unit = known[where]
        lo, n = self.off[unit], self.off[unit + 1] - self.off[unit]
        to = np.r_[0, np.cumsum(n)]
        ids = self.ids[np.arange(to[-1]) - np.repeat(to[:-1], n) + np.repeat(lo, n)]
        off = to[np.searchsorted(start, s.off)]
        if OTHER_SPACE.search(s.data.data):
            parts = []
            for i in range(s.n):
                b = s.bytes_of(i)
                parts.append(self._whole(b.decode("utf-8", "replace")) if OTHER_SPACE.search(b) else ids[off[i] : off[i + 1]])
            ids, off = np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        return ids, off


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's own; workers are reused from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
