"""Vectorised text kernels over Arrow batches: bytes in, numpy arrays out, no Python per word.

All of them work on the UTF-8 bytes of a block of whole texts. A block holds whole documents of about ``BLOCK_BYTES``
together, or one longer document. Its bytes are scanned in chunks of ``CHUNK_BYTES`` with carry (a word or line may go
over any number of chunks), so what is kept of a text are a few numbers for each of its words and lines: about ten
times the text's size at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES, CHUNK_BYTES = 1 << 20, 1 << 17
SHINGLE_WORDS = 5

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i in 0..CHUNK_BYTES."""
    steps = np.full(CHUNK_BYTES + 1, _U(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=_U)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Segments:
    """Hashes of segments of bytes, whatever their place; their starts and ends come chunk by chunk, in order."""

    def __init__(self):
        self.at, self.total, self.up, self.down = 0, 0, 1, 1
        self.starts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []

    def feed(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """``sums``: of the chunk's codes times powers of the base, before each byte and after the last."""
        n, total, up = len(sums) - 1, _U(self.total), _U(self.up)
        self.starts.append((starts + self.at, sums[starts] * up + total, _DOWN[starts] * _U(self.down)))
        self.ends.append((ends + self.at, sums[ends] * up + total))
        self.total = (self.total + int(sums[n]) * self.up) & _MASK
        self.up, self.down = self.up * int(_UP[n]) & _MASK, self.down * int(_DOWN[n]) & _MASK
        self.at += n

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each segment."""
        if not self.starts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
        begin, before, down = (np.concatenate(x) for x in zip(*self.starts))
        end, after = (np.concatenate(x) for x in zip(*self.ends))
        return begin, end, mix((after - before) * down + (end - begin).astype(_U))


def _chunks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, whether a text begins at each place and at the next chunk's first) of a block's chunks."""
    for a in range(0, len(raw), CHUNK_BYTES):
        part = raw[a : a + CHUNK_BYTES]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(part), "right")] - a] = True
        yield a, part, edge


def _sums(table: np.ndarray, part: np.ndarray) -> np.ndarray:
    out = np.zeros(len(part) + 1, _U)
    np.cumsum(table[part] * _UP[: len(part)], out=out[1:])
    return out


def _word_bounds(raw: np.ndarray, a: int, space: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the chunk at ``a`` where words begin and end."""
    b = a + len(space)
    near = np.empty(len(space) + 2, bool)  # the bytes before and after the chunk as well
    near[0], near[-1] = a == 0 or _SPACE[raw[a - 1]], b == len(raw) or _SPACE[raw[b]]
    near[1:-1] = space
    return np.flatnonzero(~space & (near[:-2] | edge[:-1])), np.flatnonzero(~space & (near[2:] | edge[1:])) + 1


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (hash of each word, first word of each document, end included)."""
    found, table = Segments(), _BYTE_LOWER if lower else _BYTE
    for a, part, edge in _chunks(raw, offsets):
        found.feed(_sums(table, part), *_word_bounds(raw, a, _SPACE[part], edge))
    starts, _, hashes = found.found()
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the first of each document; a shorter document is one shingle."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(at), np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.empty(begin[-1], _U)
    m = _U(0xD6E8FEB86659FD93)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, _U)
        for j in range(k):
            rolled *= m
            rolled += hashes[j : j + len(rolled)]
        long = np.flatnonzero(n >= k)
        if len(long):
            # places of the shingles that stay within one document
            reps = count[long]
            src = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(at[:-1][long], reps)
            dst = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begin[:-1][long], reps)
            out[dst] = rolled[src]
    for size in range(1, k):
        docs = np.flatnonzero(n == size)
        if len(docs):
            h = np.full(len(docs), _U(size))
            for j in range(size):
                h = h * m + hashes[at[:-1][docs] + j]
            out[begin[:-1][docs]] = h
    return mix(out), begin


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, ASCII letters lower-cased."""
    for _, _, raw, offsets in blocks(texts):
        h, begin = shingles(*words(raw, offsets, True), k)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            s = np.sort(h[a:b])  # a copy: what is kept of it holds no block
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield s


# Byte classes that are counted for the quality operators.
CLASSES = ("space", "newline", "upper", "lower", "digit", "symbol", "sentence_end", "bang", "other_ascii", "lead", "trail")
_CLASS = np.full(256, CLASSES.index("other_ascii"), np.uint8)
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = CLASSES.index("space")
_CLASS[0x0A] = CLASSES.index("newline")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[[ord(c) for c in "#*$%&|<>"]] = CLASSES.index("symbol")
_CLASS[[ord(c) for c in ".?"]] = CLASSES.index("sentence_end")
_CLASS[ord("!")] = CLASSES.index("bang")
_CLASS[0xC0:] = CLASSES.index("lead")
_CLASS[0x80:0xC0] = CLASSES.index("trail")

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_digit", "n_sentence_end", "n_other_ascii", "n_lead", "n_distinct_words", "n_bangs",
)
REPEAT_WORDS = 8


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """``STATS`` of every whole text, as int64 arrays. Words keep their case here."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in STATS}
    for first, end, raw, offsets in blocks(texts):
        rows, docs = slice(first, end), end - first
        counts = np.zeros((docs, 16), np.int64)
        found, found_lines, before = Segments(), Segments(), -1
        for a, part, edge in _chunks(raw, offsets):
            lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(part)))
            of = np.repeat(np.arange(hi - lo) * 16, np.diff(np.clip(offsets[lo : hi + 1], a, a + len(part))))
            of += _CLASS[part]
            counts[lo:hi] += np.bincount(of, minlength=(hi - lo) * 16).reshape(-1, 16)
            sums = _sums(_BYTE, part)
            found.feed(sums, *_word_bounds(raw, a, _SPACE[part], edge))
            # a line ends before its newline, or where its text ends; the next begins behind either
            after = np.empty(len(part) + 1, bool)
            after[0], after[1:] = before == 10, part == 10
            texts_end = edge & ~after
            texts_end[0] &= a > 0
            if a + len(part) < len(raw):
                texts_end[-1] = False  # the next chunk's
            shut = np.sort(np.concatenate([np.flatnonzero(part == 10), np.flatnonzero(texts_end)]))
            found_lines.feed(sums, np.flatnonzero(after[:-1] | edge[:-1]), shut)
            before = int(part[-1])
        starts, _, h = found.found()
        at = np.searchsorted(starts, offsets)
        c = dict(zip(CLASSES, counts.T))
        out["n_words"][rows] = np.diff(at)
        out["word_chars"][rows] = counts.sum(1) - c["space"] - c["newline"] - c["trail"]
        out["n_sentence_end"][rows] = c["sentence_end"] + c["bang"]
        for stat, name in (("n_symbols", "symbol"), ("n_upper", "upper"), ("n_lower", "lower"), ("n_digit", "digit"), ("n_bangs", "bang"), ("n_other_ascii", "other_ascii"), ("n_lead", "lead")):
            out[stat][rows] = c[name]
        # lines with a word, equal to an earlier one of the same document
        begins, ends, line = found_lines.found()
        real = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
        line, owner = line[real], np.searchsorted(offsets, begins[real], "right") - 1
        out["n_lines"][rows] = np.bincount(owner, minlength=docs)
        order = np.lexsort((line, owner))
        same = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out["n_dup_lines"][rows] = np.bincount(owner[order][1:][same], minlength=docs)
        # words that lie in an 8-word window found twice or more
        m = _U(0xA0761D6478BD642F)
        grams = np.zeros(max(0, len(h) - REPEAT_WORDS + 1), _U)
        for j in range(REPEAT_WORDS):
            grams *= m
            grams += h[j : j + len(grams)]
        grams = mix(grams)
        for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            w = np.sort(h[a:b])
            if len(w):
                out["n_distinct_words"][first + d] = 1 + int((w[1:] != w[:-1]).sum())
            if b - a <= REPEAT_WORDS:
                continue
            g = grams[a : b - REPEAT_WORDS + 1]
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(g), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(b - a + 1, np.int64)
                hit = np.flatnonzero(twice)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + REPEAT_WORDS, -1)
                out["n_repeat_words"][first + d] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out
