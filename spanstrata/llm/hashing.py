"""Word and shingle hashes of whole texts, computed on blocks of bytes with numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int) -> np.ndarray:
    if base not in _powers:
        p = np.full(BLOCK + 1, base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def delimiters(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: The white space that ends a word.
SPACE = delimiters(b" \t\n\x0b\x0c\r")


def _block(data: bytes, ends: np.ndarray):
    """Starts, ends and polynomial sums of the runs without delimiters in at most BLOCK bytes."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~ends[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE)[: len(b)], out=sums[1:])
    return start, end, (sums[end] - sums[start]) * _power_table(_BACK)[start]


def word_hashes(data: bytes, ends: np.ndarray = SPACE) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order; the text may have any length."""
    if len(data) <= BLOCK:
        start, end, raw = _block(data, ends)
        return mix(raw + (end - start).astype(np.uint64) * _ODD[7])
    out, open_sum, open_len = [], 0, 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        start, end, raw = _block(part, ends)
        size = (end - start).astype(np.uint64)
        if open_len:
            if len(start) and start[0] == 0:  # the word goes on in this block
                raw[0] = (open_sum + pow(_BASE, open_len, 1 << 64) * int(raw[0])) % (1 << 64)
                size[0] += np.uint64(open_len)
            else:
                out.append(np.array([open_sum + open_len * int(_ODD[7]) & (1 << 64) - 1], dtype=np.uint64))
                out[-1] = mix(out[-1])
            open_len = 0
        hashes = mix(raw + size * _ODD[7])
        if len(end) and end[-1] == len(part) and at + BLOCK < len(data):
            open_sum, open_len = int(raw[-1]), int(size[-1])
            hashes = hashes[:-1]
        out.append(hashes)
    if open_len:
        out.append(mix(np.array([open_sum + open_len * int(_ODD[7]) & (1 << 64) - 1], dtype=np.uint64)))
    return np.concatenate(out)


def texts_to_words(texts, ends: np.ndarray = SPACE):
    """Word hashes of each text; short texts share a block, so that numpy's fixed costs are spread."""
    group, size = [], 0

    def flush():
        start, end, raw = _block(b"\n".join(group), ends)
        hashes = mix(raw + (end - start).astype(np.uint64) * _ODD[7])
        last = np.cumsum([len(t) + 1 for t in group])
        first = 0
        for upto in np.searchsorted(start, last):
            yield hashes[first:upto]
            first = upto

    for text in texts:
        if len(text) + 1 > BLOCK - size and group:
            yield from flush()
            group, size = [], 0
        if len(text) + 1 > BLOCK:
            yield word_hashes(text, ends)
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield from flush()


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; with fewer words, of the whole run."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix((words * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _ODD[j]
    return np.unique(mix(total))
