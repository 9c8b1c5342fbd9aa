"""Word hashes of whole texts, in numpy over Arrow buffers.

Inside a task the texts of a record batch are walked in chunks of about a
mebibyte; a longer text is one chunk of its own. A word's hash is
``sum(T[byte] * P**i) mod 2**64`` over its bytes (T: a fixed random table, P
odd), taken as a difference of one running sum, then mixed. Hashes of equal
words are equal; different words of natural length collide with a chance near
2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SEED = 20240229
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i in range(at least n); grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table(fold_ascii_case: bool) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(SEED)).integers(
        1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
    if fold_ascii_case:
        table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1]
    return table


_FOLDED = _byte_table(True)


def _blank_lut() -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[[0x20, *range(0x09, 0x0E)]] = True
    return lut


def _punct_lut() -> np.ndarray:
    """ASCII bytes that are neither letters nor digits."""
    lut = np.zeros(256, dtype=bool)
    for b in range(128):
        lut[b] = not chr(b).isalnum()
    return lut


BLANK = _blank_lut()
NOT_ALNUM = _punct_lut()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (one row at least)."""
    n, first = len(off) - 1, 0
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def separators(raw: np.ndarray, plain_words: bool) -> np.ndarray:
    """Mask of bytes between words: blanks, or everything but letters and digits.

    With ``plain_words`` also the Latin-1 signs U+00A0 to U+00BF and the general
    punctuation U+2000 to U+203F separate; other non-ASCII counts as letters.
    """
    if not plain_words:
        return BLANK[raw]
    sep = NOT_ALNUM[raw]
    if len(raw) > 1 and raw.max() >= 0x80:
        pair = (raw[:-1] == 0xC2) & (raw[1:] < 0xC0)
        sep[:-1] |= pair
        sep[1:] |= pair
        if len(raw) > 2:
            triple = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] < 0xC0)
            for i in range(3):
                sep[i:len(raw) - 2 + i] |= triple
    return sep


#: Scripts written without blanks: Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han.
BLANK_FREE = np.array([(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF),
                       (0x3005, 0x3007), (0x3041, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF),
                       (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)], np.int32)
#: Ideographic and full-width signs.
WIDE_SIGNS = np.array([(0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F),
                       (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)], np.int32)


def _within(points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    k = np.searchsorted(ranges[:, 0], points, side="right") - 1
    return (k >= 0) & (points <= ranges[np.maximum(k, 0), 1])


def wide_characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes) of each character of a script without blanks, and the
    first byte of each wide sign (three bytes long)."""
    lead = np.flatnonzero(raw >= 0xE0)
    three = lead[(raw[lead] < 0xF0) & (lead + 2 < len(raw))]
    points = ((raw[three] & 15).astype(np.int32) << 12 | (raw[three + 1] & 63).astype(np.int32) << 6
              | raw[three + 2] & 63)
    own, signs = three[_within(points, BLANK_FREE)], three[_within(points, WIDE_SIGNS)]
    # Han beyond U+20000.
    four = lead[(raw[lead] == 0xF0) & (lead + 3 < len(raw))]
    four = four[raw[four + 1] >= 0xA0]
    return (np.concatenate((own, four)),
            np.concatenate((np.full(len(own), 3), np.full(len(four), 4))), signs)


def word_hashes(raw: np.ndarray, off: np.ndarray, plain_words: bool = False,
                characters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row), ASCII letters in either case alike.

    ``off`` gives the rows within ``raw``; the second result has one more entry
    than rows. With ``characters``, each character of a script without blanks is a
    word, and wide signs separate.
    """
    base = int(off[0])
    raw = raw[base:int(off[-1])]
    rel = off - base
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~separators(raw, plain_words)
    alone = length = np.zeros(0, np.int64)
    if characters:
        alone, length, signs = wide_characters(raw)
        for i in range(3):
            inside[signs + i] = False
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = rel[1:-1]
    cut = np.concatenate((cut, alone, alone + length))
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_FOLDED[raw] * _power(_P, n)[:n], out=run[1:])
    h = (run[b] - run[a]) * _power(_P_INV, n)[a]
    h = mix(h + (b - a).astype(np.uint64) * _STEP)
    return h, np.searchsorted(a, rel, side="left").astype(np.int64)


def chained(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row; a row with fewer words (but
    one) gives its whole sequence as one run. Returns (hashes, row starts)."""
    rows = len(first) - 1
    count = first[1:] - first[:-1]
    n_runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(n_runs, out=begin[1:])
    total = int(begin[-1])
    if total == 0:
        return np.zeros(0, np.uint64), begin
    row = np.repeat(np.arange(rows), n_runs)
    at = first[:-1][row] + (np.arange(total) - begin[:-1][row])
    length = np.minimum(k, count[row])
    acc = mix(words[at] + _STEP * length.astype(np.uint64))
    for j in range(1, k):
        more = length > j
        if more.all():
            acc = mix(acc * _STEP + words[at + j])
        else:
            sel = np.flatnonzero(more)
            acc[sel] = mix(acc[sel] * _STEP + words[at[sel] + j])
    return acc, begin
