"""Token ids of whole texts, exactly as the tokenizers or sentencepiece library gives them.

A byte-level BPE never merges across the pieces that its splitting pattern makes, so the ids of a text are the ids of
its pieces in a row.  ``Encoder`` finds the pieces of many texts at once with array operations, asks the library for
each piece that it has not met yet, and keeps the answers; kept pieces are found by a hash and compared byte by byte.  Texts with letters or marks whose class could depend on
the Unicode version, control characters, or a special string go to the library as a whole, as do all texts of
tokenizers of another make.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _DIGIT, _BLANK, _BREAK, _OTHER, _SEP = 1, 2, 3, 4, 5, 0
_RISKY = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xbf\xd7\xf7\u0240-\U0010ffff]"
_CALM_BYTES = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])  # of texts without such marks, but for two of U+00C0 to U+00FF
_CALM_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[0] = _SEP
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER  # what is left of two-byte letters in calm texts
    kind[48:58] = _DIGIT
    kind[32] = _BLANK
    kind[[9, 10, 13]] = _BREAK
    return kind


_KIND = _classes()


def piece_starts(a: np.ndarray) -> np.ndarray:
    """Where a piece starts in UTF-8 bytes of calm texts, which zero bytes separate (each a piece of its own).

    A run of letters, of digits or of other marks takes one blank before it along; of white space before a run, the
    last character stands alone unless it is that blank; and an apostrophe at a run's start takes s, t, m, d, re, ve
    or ll along.
    """
    kind = _KIND[a]
    n = len(a)
    start = np.ones(n, bool)
    if n < 2:
        return start
    prev, here = kind[:-1], kind[1:]
    white = (kind == _BLANK) | (kind == _BREAK)
    wp, wh = white[:-1], white[1:]
    s = start[1:]
    np.copyto(s, np.where(wp & wh, False, prev != here) | (here == _SEP) | (prev == _SEP))
    enters = wp & ~wh & (here != _SEP)
    s[enters] = prev[enters] != _BLANK
    start[np.flatnonzero(enters)] = True
    marks = np.flatnonzero(a == 39)
    if len(marks):
        before = np.where(marks > 0, kind[marks - 1], _SEP)
        marks = marks[(before != _BLANK) & (before != _OTHER)]
        pad = np.concatenate([a, np.zeros(3, np.uint8)])
        one, two = pad[marks + 1], pad[marks + 2]
        length = np.zeros(len(marks), np.int64)
        length[np.isin(one, list(b"stmd"))] = 1
        for x in (b"re", b"ve", b"ll"):
            length[(one == x[0]) & (two == x[1])] = 2
        marks, length = marks[length > 0], length[length > 0]
        start[marks + 1] = False
        after = marks + 1 + length
        start[after[after < n]] = True
    return start


def calm_pieces(text: str, size: int) -> list[str]:
    """A long text cut before single blanks between two plain letters, where a piece starts in any case."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CALM_BREAK.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


_LONG = 1 << 12  # longer pieces are not kept
_rng = np.random.default_rng(20)
_OF_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64)
_OF_PLACE = _rng.integers(0, 1 << 63, _LONG + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def piece_hashes(a: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of pieces of at most _LONG bytes: two draws for each byte and place, multiplied, summed
    and mixed with the length."""
    place = np.arange(len(a), dtype=np.int32) - np.repeat(starts.astype(np.int32), lens)
    h = np.add.reduceat(_OF_BYTE[a] * _OF_PLACE[np.minimum(place, _LONG, out=place)], starts)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= (h >> np.uint64(29)) + lens.astype(np.uint64)
    h[h == 0] = 1
    return h


class _Table:
    """From hashes to numbers, by open addressing; looks up and adds whole arrays at once."""

    def __init__(self, bits: int):
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes; -1 for unknown ones."""
        at = (h >> self.shift).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        at, h = at[open_], h[open_]
        while len(open_):
            at = (at + 1) & self.last
            key = self.keys[at]
            hit = key == h
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (key != 0)
            open_, at, h = open_[on], at[on], h[on]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct unknown hashes."""
        at = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]  # of several for one place the last stays
            won = self.keys[at] == h
            self.values[at[won]] = values[won]
            at, h, values = (at[~won] + 1) & self.last, h[~won], values[~won]


class Encoder:
    """Ids of texts for one tokenizer file: .json for the tokenizers library, .model for sentencepiece."""

    def __init__(self, path: str, most_pieces: int = 1_500_000):
        self.path, self.most_pieces = path, most_pieces
        self.piecewise = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda texts: model.encode(texts, num_threads=1)
            self.vocab_size = model.get_piece_size()
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._library = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            self.vocab_size = t.get_vocab_size(with_added_tokens=True)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
            self.piecewise = (
                split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space")
                and spec["normalizer"] is None
                and not spec["model"].get("dropout")
                and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
            )
            self._risky = re.compile("|".join([_RISKY, *(re.escape(x["content"]) for x in added)]))
            self._added = [x["content"] for x in added]
            line = self._library(["\n"])[0]
            self._line = line[0] if len(line) == 1 else None
        self._blank = self._try_blanks()
        self._clear()

    def cuts(self, text: str, size: int) -> list[str]:
        """A long text in parts of about `size` characters that have as many ids together as the text has.

        It is cut before single blanks between two plain letters.  Some tokenizers put a blank before every text, so that
        a part must not start with its own; which it is, or whether cuts are safe at all, is tried on a few words.
        """
        if len(text) <= size or self._blank is None:
            return [text]
        first, *rest = calm_pieces(text, size)
        return [first, *(x[self._blank :] for x in rest)]

    def _try_blanks(self) -> int | None:
        words = ("a", "the", "House", "nicht", "xyzzy", "I")
        pairs = [(x, y) for x in words for y in words]
        whole = self._library([f"{x} {y}" for x, y in pairs])
        for skip in (0, 1):
            first, second = self._library([x for x, _ in pairs]), self._library([f" {y}"[skip:] for _, y in pairs])
            if whole == [a + b for a, b in zip(first, second)]:
                return skip
        return None

    def _clear(self) -> None:
        self._table, self._n = _Table(max(10, (2 * self.most_pieces).bit_length())), 1
        self._ids, self._n_ids = np.zeros(1 << 16, np.uint32), 0
        self._at, self._len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._data, self._n_data, self._spot = np.zeros(1 << 18, np.uint8), 1, np.zeros(1 << 16, np.int64)  # bytes of kept pieces

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Ask the library for pieces and keep its answers; the numbers that these get."""
        white = np.fromiter((p[-1:].isspace() for p in pieces), bool, len(pieces))
        order = np.argsort(white, kind="stable")
        numbers = np.empty(len(pieces), np.int32)
        numbers[order] = self._n + np.arange(len(pieces), dtype=np.int32)
        plain = [p for p, w in zip(pieces, white) if not w]
        if self._line is not None and len(plain) > 1:
            self._keep(plain, *self._by_line(plain))
            plain = []
        pieces = plain + [p for p, w in zip(pieces, white) if w]
        for at in range(0, len(pieces), 50_000):
            part = pieces[at : at + 50_000]
            got = self._library([p.decode() for p in part])
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(part, np.fromiter((i for ids in got for i in ids), np.uint32, int(lens.sum())), lens)
        return numbers

    def _by_line(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space but a first blank: a line feed between two of them is a piece of its own."""
        text = b"\n".join(pieces).decode()
        lines = text.split("\n") if len(text) > 1 << 16 else [text]
        texts = ["\n".join(lines[i : i + 2000]) for i in range(0, len(lines), 2000)] if len(lines) > 1 else lines
        flat = np.concatenate([x for ids in self._library(texts) for x in (np.array(ids, np.uint32), np.array([self._line], np.uint32))])
        ends = np.flatnonzero(flat == self._line)
        return flat[flat != self._line], np.diff(ends, prepend=-1) - 1

    def _keep(self, part: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        if part:
            first, total = self._n, self._n_ids + len(flat)
            while first + len(part) > len(self._at):
                self._at, self._len, self._spot = (np.resize(x, 2 * len(x)) for x in (self._at, self._len, self._spot))
            while total > len(self._ids):
                self._ids = np.resize(self._ids, 2 * len(self._ids))
            self._ids[self._n_ids : total] = flat
            self._at[first : first + len(part)] = self._n_ids + np.cumsum(lens) - lens
            self._len[first : first + len(part)] = lens
            self._n, self._n_ids = first + len(part), total
            kept = [p if len(p) <= _LONG else b"" for p in part]  # longer ones are never looked up
            size = np.fromiter(map(len, kept), np.int64, len(kept))
            used = self._n_data + int(size.sum())
            while used > len(self._data):
                self._data = np.resize(self._data, 2 * len(self._data))
            self._data[self._n_data : used] = np.frombuffer(b"".join(kept), np.uint8)
            self._spot[first : first + len(part)] = self._n_data + np.cumsum(size) - size
            self._n_data = used

    def _slots(self, texts: list[str]) -> np.ndarray:
        """Slots of the pieces of calm texts; slot 0 after each text."""
        a = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)
        start = piece_starts(a)
        at = np.flatnonzero(start)
        lens = np.diff(at, append=len(a))
        h = piece_hashes(a, at, lens)
        if self._n > self.most_pieces:
            self._clear()
        slots = self._table.get(h).astype(np.int64)
        slots[a[at] == 0] = 0
        new = np.flatnonzero((slots < 0) & (lens <= _LONG))
        if len(new):
            known, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            data, spots = a.tobytes(), new[first]
            pieces = [data[x : x + n] for x, n in zip(at[spots].tolist(), lens[spots].tolist())]
            numbers = self._learn(pieces)
            self._table.add(known, numbers)
            slots[new] = numbers[back]
        told = np.flatnonzero(slots >= 0)  # a hash may be that of another piece: bytes decide
        shift = np.zeros(len(slots), np.int64)
        shift[told] = self._spot[slots[told]] - at[told]
        place = np.arange(len(a)) + np.repeat(shift, lens)
        other = np.flatnonzero(self._data[np.minimum(place, self._n_data - 1, out=place)] != a)
        if len(other):
            slots[np.unique(np.searchsorted(at, other, "right") - 1)] = -1
        for i in np.flatnonzero(slots < 0).tolist():
            slots[i] = self._learn([a[at[i] : at[i] + lens[i]].tobytes()])[0]
        return slots

    def _parts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        if not self.piecewise:
            return [], list(range(len(texts)))
        joined = "".join(texts)
        data = joined.encode()
        if not data.translate(None, _CALM_BYTES) and b"\xc3\x97" not in data and b"\xc3\xb7" not in data and not any(x in joined for x in self._added):
            return list(range(len(texts))), []
        calm, other = [], []
        for i, t in enumerate(texts):
            (other if self._risky.search(t) else calm).append(i)
        return calm, other

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        calm, other = self._parts(texts)
        if calm:
            slots = self._slots([texts[i] for i in calm])
            total = np.cumsum(self._len[slots])[slots == 0]
            out[calm] = np.diff(total, prepend=0)
        if other:
            out[other] = [len(x) for x in self._library([texts[i] for i in other])]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many of them each text has."""
        calm, other = self._parts(texts)
        counts, parts = np.zeros(len(texts), np.int64), []
        if calm:
            slots = self._slots([texts[i] for i in calm])
            n = self._len[slots].astype(np.int64)
            counts[calm] = np.diff(np.cumsum(n)[slots == 0], prepend=0)
            src = np.repeat(self._at[slots] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            parts.append((calm, self._ids[src]))
        if not other:
            return (parts[0][1] if parts else np.zeros(0, np.uint32)), counts
        whole = self._library([texts[i] for i in other])
        counts[other] = [len(x) for x in whole]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for i, ids in zip(other, whole):
            out[ends[i] - len(ids) : ends[i]] = ids
        if calm:
            mine = np.zeros(len(texts), bool)
            mine[calm] = True
            out[np.repeat(mine, counts)] = parts[0][1]
        return out, counts


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, so that its kept pieces serve all its tasks."""
    return Encoder(path)
