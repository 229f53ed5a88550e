"""Word shingles of whole texts as sets of 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3,
                    0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)
# Bytes hashed at once, and the powers that go with them: some forty bytes of memory for each.
SEGMENT = 1 << 17
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _segment_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a segment that begins and ends between words."""
    a = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(max(len(a) + 1, SEGMENT + 2))
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a + np.uint64(1)) * up[:len(a)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * _PLACES[5]), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and each text's number of words."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group, size, first = [], 0, 0

    def flush(last: int) -> None:
        nonlocal group, size
        if group:
            h, start = _segment_words(b"\n".join(group))
            begins = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])
            counts[last - len(group):last] += np.diff(np.append(np.searchsorted(start, begins), len(start)))
            hashes.append(h)
            group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > SEGMENT:
            flush(i)
            first = 0
            while first < len(text):
                stop = first + SEGMENT
                while stop < len(text) and not _SPACE[text[stop]]:
                    stop += 1
                h, _ = _segment_words(text[first:stop])
                hashes.append(h)
                counts[i] += len(h)
                first = stop
            continue
        if size + len(text) > SEGMENT:
            flush(i)
        group.append(text)
        size += len(text) + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words, but not none, has one.

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, with A-Z in lower case.
    """
    h, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    n = len(h)
    whole = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for j in range(words if len(whole) else 0):
        whole += h[j:j + len(whole)] * _PLACES[j]
    whole = mix(whole)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(whole[at:at + count - words + 1]))
        elif count:
            out.append(mix((h[at:at + count] * _PLACES[:count]).sum(keepdims=True) + _PLACES[6:] * np.array([count], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
