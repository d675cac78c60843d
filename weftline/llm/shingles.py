"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle; the similarity that links two documents, as a percentage.
SPAN, PERCENT = 5, 80

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers (splitmix's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SLOTS = mix(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _powers[int(base)] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


#: Bytes hashed at once; a longer text is cut at white space, and only a longer word is held as a whole.
PIECE = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def _cut(text: bytes):
    """Pieces of a text of about PIECE bytes, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(bytes([c]), at, at + PIECE) for c in _SPACES)
        if end <= at:
            ends = [e for c in _SPACES if (e := text.find(bytes([c]), at + PIECE)) >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, a polynomial in its bytes from prefix sums over all bytes, and the number of words of each part."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], white]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_BASE, len(data)), dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * _power(_BACK, len(data))[starts])
    limits = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z in lower case, and the number of words of each text.

    Texts are hashed in pieces of bounded size, so what is held beside the words'
    hashes does not grow with a text.
    """
    counts, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint64)]
    parts, owners, held = [], [], 0

    def flush():
        hashes, n = _hashes(parts)
        found.append(hashes)
        np.add.at(counts, owners, n)

    for i, text in enumerate(texts):
        for part in _cut(text.encode("utf-8", "surrogatepass").lower()):  # bytes.lower() touches A-Z alone
            if held + len(part) > PIECE and parts:
                flush()
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(i)
            held += len(part)
    if parts:
        flush()
    return np.concatenate(found), counts


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text, one after the other, and their numbers.

    Fewer words than a shingle's are one shingle, the whole sequence; no word, none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        n = len(hashes) - SPAN + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for j in range(SPAN):
                rolled += hashes[j : j + n] * _SLOTS[j]
            inside = owner[:n] == owner[SPAN - 1 :]
            found, of = mix(rolled[inside]), owner[:n][inside]
        else:
            found, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < SPAN))
        whole = [mix(np.sum(hashes[ends[i] - counts[i] : ends[i]] * _SLOTS[: counts[i]], dtype=np.uint64, keepdims=True) + np.uint64(counts[i])) for i in short]
    sizes = np.bincount(of, minlength=len(texts))
    sizes[short] = 1
    out = np.zeros(int(sizes.sum()), np.uint64)
    last = np.cumsum(sizes)
    is_short = np.zeros(len(texts), bool)
    is_short[short] = True
    out[np.repeat(~is_short, sizes)] = found
    for i, h in zip(short, whole, strict=True):
        out[last[i] - 1] = h[0]
    for a, b in zip((last - sizes).tolist(), last.tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    of = np.repeat(np.arange(len(texts)), sizes)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[fresh], np.bincount(of[fresh], minlength=len(texts))


def fingerprints(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, by the sum of its members' hashes."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)
