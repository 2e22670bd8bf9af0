"""Distinct word shingles of UTF-8 texts as sorted 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: Space and the control characters 9 to 13, the ones between words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Word characters of plain words: letters and digits of ASCII, and all bytes of other characters.
WORD = np.zeros(256, bool)
for _first, _end in ((48, 58), (97, 123), (128, 256)):
    WORD[_first:_end] = True
_random = np.random.default_rng(2024)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
POWER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """POWER ** 0 ... POWER ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), POWER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``run_hashes`` needs of a sequence of 64-bit hashes."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes) * powers(len(hashes))[: len(hashes)], out=total[1:])
    back = np.full(len(hashes) + 1, INVERSE, np.uint64)
    back[0] = 1
    return total, np.multiply.accumulate(back)


def run_hashes(sums: tuple[np.ndarray, np.ndarray], first, end) -> np.ndarray:
    """Hash of each run [first, end) of the sequence, the same wherever the run stands."""
    total, back = sums
    return (total[end] - total[first]) * back[first]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in each text, in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[data]
    inside = np.flatnonzero(~blank)
    first = np.r_[True, blank[:-1]] & ~blank
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = np.cumsum(first[inside]) - 1
    within = inside - starts[word]
    hashes = BYTE[data[inside]] * powers(int(within.max()) + 1)[within]
    begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.r_[0, ends]))
    return mixed(np.add.reduceat(hashes, begins)), counts


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``n`` words in each text.

    A text with fewer words has the whole sequence as its one shingle; one without words none.
    """
    words, counts = word_hashes([lowered(np.frombuffer(t, np.uint8)).tobytes() for t in texts])
    out, at = [], 0
    for count in counts:
        own = words[at : at + count]
        at += count
        size = min(n, int(count))
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.full(count - size + 1, size, np.uint64)
        for i in range(size):
            total = mixed(total * POWER + own[i : count - size + 1 + i])
        out.append(np.unique(total))
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased and without punctuation, and the words per text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    # Capitals of Latin-1 in UTF-8.
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[latin[data[latin] != 0x97]] += 32
    inside = np.flatnonzero(WORD[data])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1] + 1])
    starts = inside[begins]
    within = inside - np.repeat(starts, np.diff(np.r_[begins, len(inside)]))
    hashes = np.add.reduceat(BYTE[data[inside]] * powers(int(within.max()) + 1)[within], begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, np.r_[0, ends]))
