"""Words of whole texts as 64-bit hashes, by Arrow and array arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = np.uint64(33)
#: Each byte with A-Z lower-cased and the white space 09-0D as a space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> _R)
    x = x * _M1
    x = x ^ (x >> _R)
    x = x * _M2
    return x ^ (x >> _R)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of pairs of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def slices(texts: pa.Array, at_once: int = 2_000_000) -> list[pa.Array]:
    """Texts in runs of about so many bytes, one text at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, k = [], 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + at_once, side="right")))
        out.append(texts.slice(k, stop - k))
        k = stop
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bounds of each text's words, each word's number, the
    distinct words. Texts hold no null."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]  # by byte: Arrow's own white space takes in bytes of longer characters
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(data))
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        keep = full.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))  # to_pylist takes several times as long


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's words, and the words' hashes."""
    bounds, index, words = tokens(texts)
    return bounds, hashes(words)[index] if len(words) else np.zeros(0, np.uint64)


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, their whole sequence; of none, nothing."""
    if not len(word):
        return word
    n = max(1, len(word) - width + 1)
    h = mix(word[:n] + np.uint64(min(width, len(word))))
    for k in range(1, min(width, len(word))):
        h = combine(h, word[k : k + n])
    return np.unique(h)
