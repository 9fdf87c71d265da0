"""Vectorised text steps over Arrow arrays, shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as str.strip has it, as the body of an RE2 character class.
WHITE = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, which text each is of, its number from 1); null texts have none."""
    lists = pc.split_pattern(texts, "\n")
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    return pc.list_flatten(lists), of, number.astype(np.int32)


def normal(lines: pa.Array) -> pa.Array:
    """Trimmed, in lower case, runs of white space as one blank and runs of digits as one digit."""
    lines = pc.utf8_trim(pc.replace_substring_regex(lines, f"[{WHITE}]+", " "), " ")
    return pc.replace_substring_regex(pc.utf8_lower(lines), "[0-9]+", "0")


def hashed(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, each distinct one hashed once."""
    import xxhash

    coded = values.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(x or "", seed) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices.fill_null(0))] if len(values) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x81DADEF4BC2DD44D)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of size words, offsets of each list's runs); a shorter list has one run of all its words."""
    counts = np.diff(offsets)
    runs = np.maximum(counts - size + 1, 1)
    out = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    start = np.repeat(offsets[:-1], runs) + np.arange(out[-1]) - np.repeat(out[:-1], runs)
    stop = np.minimum(start + size, np.repeat(offsets[1:], runs))
    total = np.zeros(len(start), np.uint64)
    padded = np.append(words, np.uint64(0))
    for k in range(size):
        at = start + k
        total = mix(total + np.where(at < stop, padded[np.minimum(at, len(words))], np.uint64(k + 1)))
    return total, out
