"""Words of many texts at once, as 64-bit hashes.

Words are runs of bytes other than space and the bytes 9 to 13; A-Z count as a-z. Texts come as
one byte array with offsets, so that a step costs a few array operations and none per word.
"""

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for every byte, capital letters having those of the small ones.
LETTER = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64)
LETTER[65:91] = LETTER[97:123]
#: Bytes that are hashed at once; powers are kept for as many.
PIECE = 1 << 20
_powers = {}


def mixed(h):
    """Hashes whose every bit depends on every bit of the given ones."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power():
    """Powers of an odd number and of its inverse, modulo 2 ** 64, up to PIECE."""
    if len(_powers.get("up", ())) != PIECE + 1:
        up, down = np.full(PIECE + 1, _ODD, np.uint64), np.full(PIECE + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def hashed(data, offsets):
    """Hash of every word in order, and where each text's words begin (one more entry than texts).

    A word's hash is a sum over its letters, taken from running sums where it begins and ends. These go on
    from piece to piece, so that long texts need little more memory than their words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _power()
    cuts = np.asarray(offsets)
    begins, begun, inverse, finished, sums = [], [], [], [], []
    base, scale, back, before = np.uint64(0), np.uint64(1), np.uint64(1), False
    with np.errstate(over="ignore"):
        for low in range(0, n, PIECE):
            high = min(n, low + PIECE)
            solid = ~BLANK[data[low:high]]
            apart = np.zeros(high - low, bool)  # a text begins here
            apart[cuts[np.searchsorted(cuts, low) : np.searchsorted(cuts, high)] - low] = True
            last = np.r_[before, solid[:-1]]
            first = np.flatnonzero(solid & (~last | apart))
            stop = np.flatnonzero(last & (~solid | apart))
            local = np.zeros(high - low + 1, np.uint64)
            np.cumsum(LETTER[data[low:high]] * up[: high - low], out=local[1:])
            begins.append(first + low)
            begun.append(base + scale * local[first])
            inverse.append(back * down[first])
            finished.append(stop + low)
            sums.append(base + scale * local[stop])
            base, scale, back = base + scale * local[-1], scale * up[high - low], back * down[high - low]
            before = bool(solid[-1])
        if before:
            finished.append(np.array([n]))
            sums.append(np.array([base], np.uint64))
        starts, ends = np.concatenate(begins), np.concatenate(finished)
        h = (np.concatenate(sums) - np.concatenate(begun)) * np.concatenate(inverse)
    return mixed(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def pieces(offsets, most=1 << 20):
    """Runs of texts of about ``most`` bytes: (first, last + 1); a longer text is one by itself."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop
