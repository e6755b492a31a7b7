"""Token ids by the tokenizers library, with a bounded memo of pieces.

A byte-level BPE splits a text before each single space that stands between two
other characters, around each such line feed, and before a mark that follows a
letter or digit, whatever else the text holds.  Pieces between these places are
encoded independently, so a piece that was met before needs no second encoding:
its ids are copied from a pool.  Pieces are found and looked up in numpy, by a
64-bit hash of their bytes, for a chunk of documents at once; the bytes of an
entry are kept and compared, and a piece that only shares a hash with another
is not looked up: its text is encoded whole.
Texts with other white space, with white space that touches white space or an
end, or with the string of a special or added token, are encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import common

#: Slots of the memo; half of them are filled at most (about 25 bytes each).
MEMO_BITS = 21
#: Longer pieces are not remembered.
MEMO_BYTES = 64
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: Pieces that are given to the tokenizer as one text.
PIECES = 8192


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo:
    """From hashes of pieces to ids: a hash table with open addressing in numpy arrays."""

    def __init__(self, bits: int = MEMO_BITS):
        self.mask = (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, dtype=np.uint64)
        self.start = np.zeros(self.mask + 1, dtype=np.int64)
        self.size = np.zeros(self.mask + 1, dtype=np.int32)
        self.word = np.zeros(self.mask + 1, dtype=np.int64)  # where the bytes of an entry begin in letters
        self.letters_of = np.zeros(self.mask + 1, dtype=np.int32)
        self.letters = np.zeros(1 << 16, dtype=np.uint8)
        self.written = 0
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.filled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        open_ = np.arange(len(h))
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            k = self.keys[slot]
            hit = k == h[open_]
            out[open_[hit]] = slot[hit]
            go = ~hit & (k != 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return out

    def add_ids(self, ids: np.ndarray) -> int:
        """Append ids to the pool; where they begin."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), dtype=np.uint32)])
        self.pool[self.used : need] = ids
        self.used = need
        return need - len(ids)

    def holds(self, slot: np.ndarray, body: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
        """Whether the entries are of just these bytes."""
        at = self.word[slot]
        return common.same_bytes(body, begin, finish, self.letters, at, at + self.letters_of[slot])

    def put(self, h: np.ndarray, start: np.ndarray, size: np.ndarray, body: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> None:
        """Enter distinct hashes that are not there yet, with the bytes body[begin:finish] of each."""
        self.filled += len(h)
        letters_of = finish - begin
        where, _, word = common.ragged(begin, letters_of)
        need = self.written + len(where)
        if need + 8 > len(self.letters):  # with room to read eight bytes from any letter on
            self.letters = np.concatenate([self.letters, np.zeros(max(need, len(self.letters)), dtype=np.uint8)])
        self.letters[self.written : need] = body[where]
        word, self.written = word + self.written, need
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)  # one newcomer for each slot
            take = np.flatnonzero(free)[one]
            at, who = slot[take], left[take]
            self.keys[at], self.start[at], self.size[at], self.word[at], self.letters_of[at] = h[who], start[who], size[who], word[who], letters_of[who]
            stay = np.ones(len(left), dtype=bool)
            stay[take] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123))] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_RARE = np.zeros(256, dtype=bool)
_RARE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: All white space of more than one byte in UTF-8.
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_LEADS = sorted({w[0] for w in _WIDE})


def _count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def pieces(body: np.ndarray, at: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Which documents (body[at[i] : at[i + 1]]) must be encoded whole, and where pieces begin in all of them.  added: strings of added tokens."""
    n = len(body)
    feed = body == 10
    blank = (body == 32) | feed
    odd = _RARE[body]
    for lead in _LEADS:
        where = np.flatnonzero(body == lead)
        for w in _WIDE:
            if w[0] == lead and len(where):
                hit = where[where + len(w) <= n]
                for k in range(1, len(w)):
                    hit = hit[body[hit + k] == w[k]]
                odd[hit] = True
    odd[1:] |= blank[1:] & blank[:-1]
    full = at[1:] > at[:-1]
    first, last = at[:-1][full], at[1:][full] - 1
    odd[first] |= blank[first]
    odd[last] |= blank[last]
    raw = body.tobytes() if added else b""
    for token in added:
        i = raw.find(token)
        while i >= 0:
            odd[i] = True
            i = raw.find(token, i + 1)
    whole = _count(odd, at) > 0
    begin = blank.copy()
    begin[1:] |= feed[:-1]
    if n > 1:
        after = _ALNUM[body]
        if n > 2:
            after[1:] |= (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7) & (body[1:] >= 0x80)
        begin[1:] |= _MARK[body[1:]] & after[:-1]
    begin[first] = True
    return whole, np.flatnonzero(begin)


class Encoder:
    """encode(text) gives the ids of a whole text as an uint32 array."""

    def __init__(self, path: str | None = None, bits: int = MEMO_BITS):
        self.tokenizer = _load(path or default_tokenizer())
        self.memo = Memo(bits)
        self.feed = self._plain(["\n"])[0]
        self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.memo_works = self.tokenizer.normalizer is None  # a normaliser may look past the places where pieces are cut

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has.  They are encoded as the lines of one text."""
        if len(lines) > PIECES:
            parts = [self._encode(lines[i : i + PIECES]) for i in range(0, len(lines), PIECES)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(self.feed) == 1 and "\n" not in lines:
            ids = self._plain(["\n".join(lines)])[0]
            cut = np.flatnonzero(ids == self.feed[0])
            if len(cut) == len(lines) - 1:
                return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        each = self._plain(lines)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _strangers(self, body: np.ndarray, begin: np.ndarray, finish: np.ndarray, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Pieces that share a hash with other bytes, in the memo or in an earlier piece of this chunk (an earlier one in order of hash)."""
        known, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        order = new[np.argsort(h[new], kind="stable")]
        i = np.flatnonzero(h[order][1:] == h[order][:-1]) + 1
        a, b = order[i], order[i - 1]
        wrong = a[~common.same_bytes(body, begin[a], finish[a], body, begin[b], finish[b])]
        if len(wrong):  # all pieces with such a hash
            wrong = new[np.isin(h[new], h[wrong])]
        return np.concatenate([known[~self.memo.holds(slot[known], body, begin[known], finish[known])], wrong])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in one array, each text followed by ``end``, and how many each has."""
        body, at = common.text_bytes(column)
        n, memo = len(at) - 1, self.memo
        whole, begin = pieces(body, at, self.added)
        whole |= not self.memo_works
        doc = np.searchsorted(at, begin, "right") - 1
        keep = ~whole[doc]
        finish = np.append(begin[1:], len(body))[keep]
        begin, doc = begin[keep], doc[keep]
        h = common.piece_hashes(body, begin, finish)
        h[h == 0] = 1  # 0 marks a free slot
        slot = memo.find(h)
        alike = self._strangers(body, begin, finish, h, slot)
        if len(alike):
            whole[doc[alike]] = True
            keep = ~whole[doc]
            begin, finish, doc, h, slot = begin[keep], finish[keep], doc[keep], h[keep], slot[keep]
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            if memo.filled + len(new) > memo.mask // 2:
                memo.clear()
                slot[:] = -1
                miss = np.arange(len(h))
                new, one = np.unique(h, return_index=True)
        kept = memo.used
        start, size = memo.start[slot], memo.size[slot].astype(np.int64)
        if len(miss):
            one = miss[one]
            raw = body.tobytes()
            b, e = begin[one], finish[one]
            feeds = (e - b == 1) & (body[b] == 10)
            got = np.zeros(len(one), dtype=np.int64)
            size_ = np.zeros(len(one), dtype=np.int64)
            for group in (np.flatnonzero(feeds), np.flatnonzero(~feeds)):
                if len(group):
                    ids, many = self._encode([raw[x:y].decode() for x, y in zip(b[group].tolist(), e[group].tolist(), strict=True)])
                    got[group] = memo.add_ids(ids) + np.cumsum(many) - many
                    size_[group] = many
            short = e - b <= MEMO_BYTES
            memo.put(new[short], got[short], size_[short], body, b[short], e[short])
            kept = memo.used
            k = np.searchsorted(new, h[miss])
            start[miss], size[miss] = got[k], size_[k]
        if whole.any():
            rows = np.flatnonzero(whole)
            each = self._plain([bytes(body[at[i] : at[i + 1]]).decode() for i in rows.tolist()])
            first = np.array([memo.add_ids(x) for x in each])
            place = np.searchsorted(doc, rows)
            start, size, doc = np.insert(start, place, first), np.insert(size, place, [len(x) for x in each]), np.insert(doc, place, rows)
        if end is not None:
            place = np.searchsorted(doc, np.arange(n), "right")
            start, size, doc = np.insert(start, place, memo.add_ids(np.array([end], np.uint32))), np.insert(size, place, 1), np.insert(doc, place, np.arange(n))
        total = np.cumsum(size)
        ids = memo.pool[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        memo.used = kept  # texts encoded whole are not remembered
        return ids, np.bincount(doc, size, minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each Python worker, so that later tasks find the memo filled."""
    return Encoder(path)
