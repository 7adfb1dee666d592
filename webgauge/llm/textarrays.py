"""Texts of an Arrow batch as flat numpy arrays: bytes, words, rolling hashes.

Spans of bytes that are told apart by their hash (words, stretches) are hashed by lanes of eight bytes: each lane is mixed with
a key of its place, and the mixed lanes are summed. Windows of words are hashed two by two, each step mixed. Neither has
the structure of a polynomial modulo a power of two, under which some different texts always collide. Such polynomials (``prefix``, ``spans``) serve only
where a collision does no harm: to choose minimizers, to sort before bytes are compared, to number features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_ROOT = 0xD1342543DE82EF95
_INVERSE = pow(_ROOT, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Values of the 256 bytes in the hash of a word.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def spaces(text: np.ndarray) -> np.ndarray:
    """SPACE[text], by comparisons."""
    return (text == 0x20) | (text - np.uint8(0x09) < 5)


def lowered(text: np.ndarray) -> np.ndarray:
    """LOWER[text], by comparisons."""
    return text | ((text - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for k, root in (("up", _ROOT), ("down", _INVERSE)):
            steps = np.full(size, root, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


#: Bits of a lane that belong to a span's first 0 to 8 bytes.
_KEPT_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row if that is longer."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each text begins (one more at the end). Null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, offsets - offsets[0]


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Raw hashes of the spans [begin, end)."""
    _, down = powers(len(sums))
    return (sums[end] - sums[begin]) * down[begin]


def _short_hashes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What span_hashes() has for spans of at most eight bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lane = np.ndarray(len(text) + 1, "<u8", buffer=padded.data, strides=(1,))[begin]
    lane &= _KEPT_BITS[size]
    return mix(mix(lane ^ U64(mix_int(_ROOT))) + size.astype(U64) * U64(_MULT))


def span_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """A 64-bit hash of each span [begin, end) of a text's bytes, and, if wide, a second one; a few bytes of work for each byte of the spans.

    The second sums the mixed lanes once they are multiplied and folded, so that it doesn't follow from the first.
    """
    size = end - begin
    if not len(size):
        return np.zeros(0, U64), np.zeros(0, U64) if wide else None
    if not wide and (few := size <= 8).any():  # most words are one lane, which needs no sums
        whole = np.empty(len(size), U64)
        whole[few] = _short_hashes(text, begin[few], size[few])
        if not few.all():
            whole[~few] = span_hashes(text, begin[~few], end[~few])[0]
        return whole, None
    lanes = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(lanes) - lanes
    place = np.arange(first[-1] + lanes[-1]) - np.repeat(first, lanes)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(len(text) + 1, "<u8", buffer=padded.data, strides=(1,))  # eight bytes from every place on
    lane = words[np.repeat(begin, lanes) + 8 * place]
    last = first + lanes - 1
    left = (8 * (size - 8 * (lanes - 1))).astype(U64)  # bits of the last lane
    lane[last] &= np.where(left >= 64, ~U64(0), (U64(1) << (left & U64(63))) - U64(1))
    lane = mix(lane ^ mix(place.astype(U64) * U64(_MULT) + U64(_ROOT)))
    whole = mix(np.add.reduceat(lane, first) + size.astype(U64) * U64(_MULT))
    if not wide:
        return whole, None
    lane *= U64(0xA24BAED4963EE407)
    lane ^= lane >> U64(32)
    return whole, mix(np.add.reduceat(lane, first) + size.astype(U64) * U64(_ROOT))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mix(a * U64(_MULT) + b)


class Words:
    """Words between ASCII white space (or of the bytes marked by ``inside``) of a slice of texts.

    begin, end: byte positions of each word; first: of each text, the number of its first word (one more at
    the end); hashes: 64 bits of each word (by lanes).
    """

    def __init__(self, text: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None):
        self.text = text = lowered(text) if lower else text
        self.offsets = offsets
        is_in = ~spaces(text) if inside is None else inside[text]
        starts, ends = is_in.copy(), is_in.copy()
        if len(text):
            starts[1:] &= ~is_in[:-1]
            ends[:-1] &= ~is_in[1:]
            bounds = offsets[(offsets > 0) & (offsets < len(text))]
            starts[bounds] = is_in[bounds]
            ends[bounds - 1] = is_in[bounds - 1]
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.counts = np.diff(self.first)
        self.hashes, _ = span_hashes(text, self.begin, self.end)

    def texts(self) -> np.ndarray:
        """For each word, the number of its text in the slice."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, length: int, checks: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words at which a window of ``length`` words of one text starts, and the hashes; checks: second ones."""
        n = len(self.begin)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero((np.arange(n) + length) <= np.repeat(self.first[1:], self.counts))
        # windows of 1, 2, 4, ... words, joined from the left where length has that power of two
        part, size, out, have = span_hashes(self.text, self.begin, self.end, True)[1] if checks else self.hashes, 1, None, 0
        while size <= length:
            if length & size:
                out, have = (part if out is None else paired(out[: len(out) - size], part[have:])), have + size
            if 2 * size <= length:
                part = paired(part[:-size], part[size:])
            size *= 2
        return at, out[at]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``length`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Longs, and which of them are not null (null: 0)."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), known
