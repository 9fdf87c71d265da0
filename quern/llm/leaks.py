"""Problem 9: evaluation texts inside training text, by CGK embedding and bit-sampling LSH.

Windows slide over items and documents. The CGK walk reads a window's words: at each step it puts out the word under the pointer
and moves on if a random bit of (step, word) is set, so that a small edit distance between windows becomes a small Hamming distance
between walks. A key is a sample of a walk's steps; keys in as many repetitions as the target recall needs bring windows
together, and the pairs are then verified by their exact edit distance. How often windows with so many edits share a key is measured
on random windows, not guessed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import arrowtext
from quern.session import SALTS, cut, spread

#: Steps of the walk for each word of a window, and steps of a key.
STRETCH, SAMPLED = 2, 5
#: Random windows on which the rate of shared keys is measured.
MEASURED = 2_000
#: Sizes of item windows: an item is looked for by its windows of the largest size that it has.
SIZES = (10, 14, 20, 28, 40, 56, 80, 112, 160, 224, 320, 448, 640)
#: Bytes of item windows and their keys up to which they are broadcast; beyond, keys are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit symbols in one array, and where each text's words start in it. Null has no words."""
    plain = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.utf8_trim(pc.replace_substring_regex(plain, r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(plain, " ")
    sizes = np.where(np.asarray(pc.equal(plain, "")), 0, np.asarray(pc.list_value_length(lists)))
    flat = lists.flatten()
    full = np.flatnonzero(np.asarray(pc.not_equal(flat, "")))
    return arrowtext.hashed(flat.take(pa.array(full)), 17), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Walk:
    """The random bits and samples of the embedding of windows of one size, from a seed."""

    def __init__(self, window: int, repetitions: int, seed: int = 11) -> None:
        random = np.random.default_rng(seed + window)
        self.window, steps = window, STRETCH * window
        self.salts = [random.integers(1, 2**63, steps, dtype=np.uint64) for _ in range(repetitions)]
        self.samples = [sorted(random.choice(steps, min(SAMPLED, steps), replace=False).tolist()) for _ in range(repetitions)]
        self.factor = [random.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1) for _ in range(repetitions)]

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The keys, one array for each repetition, of the windows of symbols at starts."""
        last = starts + self.window
        padded = np.append(symbols, np.uint64(1))
        for salts, sample, factor in zip(self.salts, self.samples, self.factor, strict=True):
            at, key, chosen = starts.copy(), np.zeros(len(starts), np.uint64), set(sample)
            for step in range(sample[-1] + 1):
                word = padded[np.where(at < last, at, len(symbols))]
                mixed = (word ^ salts[step]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
                if step in chosen:
                    key += mixed * factor[step]
                at += (mixed & np.uint64(1)).astype(np.int64)
            yield key


def edited(random: np.random.Generator, window: np.ndarray, edits: int) -> np.ndarray:
    """A window of the same length after so many random changes, insertions and removals of words."""
    out = window.tolist()
    for _ in range(edits):
        k, what = int(random.integers(len(out))), int(random.integers(3))
        new = int(random.integers(1, 2**62))
        if what == 0:
            out[k] = new
        elif what == 1:
            out.insert(k, new)
        else:
            del out[k]
    out += [int(x) for x in random.integers(1, 2**62, max(0, len(window) - len(out)))]
    return np.array(out[: len(window)], np.uint64)


@lru_cache(maxsize=64)
def shared_rate(window: int, edits: int) -> float:
    """How often a window shares a key with its copy after so many edits, measured on random windows."""
    if not edits:
        return 1.0
    random = np.random.default_rng(5)
    plain = random.integers(1, 2**62, (MEASURED, window), dtype=np.uint64)
    other = np.stack([edited(random, w, edits) for w in plain])
    starts = np.arange(MEASURED) * window
    hits = [np.mean(a == b) for a, b in zip(Walk(window, 8, 99).keys(plain.ravel(), starts), Walk(window, 8, 99).keys(other.ravel(), starts), strict=True)]
    return float(np.mean(hits))


def repetitions_for(recall: float, window: int, edits: int) -> int:
    """Repetitions until a window with so many edits shares a key at the recall; identical windows share every key."""
    rate = shared_rate(window, edits)
    return 1 if rate >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - rate)))


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", least: int = 10, edits: int = 0, recall: float = 0.99) -> DataFrame:
    """Rows (doc_id, item_id) of the documents that hold at least `least` consecutive words of an item, with up to `edits` word edits.

    Words are runs of letters and digits; case, punctuation and white space don't count. Items shorter than `least` words have
    no such passage. Null and blank texts leak nothing; repeated ids give one row for a pair. With edits 0 every pair is found;
    with more, the repetitions reach the recall.
    """
    return _search(documents, items, doc_id, item_id, text_col, [(least, edits)], False, recall)


def near_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", share: float = 0.1, recall: float = 0.99) -> DataFrame:
    """Rows (doc_id, item_id) of the documents with a passage that is an item-sized window of the item but for a share of its words.

    An item is looked for by its windows of the largest of SIZES that it has; the edit distance in words is at most `share` of
    that size, and one at least. Items below the smallest size are found by no window. Else as leaked.
    """
    return _search(documents, items, doc_id, item_id, text_col, [(n, max(1, int(share * n))) for n in SIZES], True, recall)


def _windows(symbols: np.ndarray, offsets: np.ndarray, size: int, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of the windows of a size in each text; with largest, only of texts that have no window of the next size."""
    n = np.diff(offsets)
    counts = np.maximum(n - size + 1, 0)
    if largest:
        above = [s for s in SIZES if s > size]
        counts = np.where(n >= above[0], 0, counts) if above else counts
    of = np.repeat(np.arange(len(n)), counts)
    return offsets[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts), of


def _search(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str, sizes: list[tuple[int, int]], largest: bool, recall: float) -> DataFrame:
    texts = items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n_words = F.size(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    # the windows of each size, from the items' lengths alone
    tops = [*[n for n, _ in sizes][1:], None]
    own = [F.when((F.col("n") >= n) & (F.lit(True) if top is None or not largest else F.col("n") < top), F.col("n") - n + 1).otherwise(0) for (n, _), top in zip(sizes, tops, strict=True)]
    counts = texts.select(n_words.alias("n")).agg(*[F.sum(c).alias(f"c{k}") for k, c in enumerate(own)], F.sum("n").alias("words")).first()
    walks = [(n, e, repetitions_for(recall, n, e)) for (n, e), c in zip(sizes, counts[:-1], strict=True) if c]
    # a window has its start, its item and, for each repetition, a key and a place
    size = (counts[-1] or 0) * 16 + sum(c * (16 + 16 * r) for c, (_, _, r) in zip([c for c in counts[:-1] if c], walks, strict=True))
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = _by_broadcast(docs, texts, walks, largest) if size <= BROADCAST_BYTES else _by_shuffle(docs, texts, walks, largest)
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def _by_broadcast(docs: DataFrame, texts: DataFrame, walks: list[tuple[int, int, int]], largest: bool) -> DataFrame:
    table = texts.toArrow().combine_chunks()
    item_ids = table.column("item").combine_chunks() if table.num_rows else pa.array([], table.schema.field("item").type)
    symbols, offsets = words(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    known = np.unique(symbols)
    sides = []
    for n, e, r in walks:
        starts, owners = _windows(symbols, offsets, n, largest)
        if len(starts):
            keys = list(Walk(n, r).keys(symbols, starts))
            orders = [np.argsort(k, kind="stable") for k in keys]
            sides.append((n, e, r, starts, owners, [k[o] for k, o in zip(keys, orders, strict=True)], orders))
    shared = docs.sparkSession.sparkContext.broadcast((symbols, known, item_ids, sides))
    schema = T.StructType([docs.schema["doc"], T.StructField("item", texts.schema["item"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, known, item_ids, sides = shared.value
        for batch in batches:
            own, offsets = words(batch.column(1))
            if not len(own) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            outside = np.concatenate([[0], np.cumsum(known[at] != own)])
            pairs: set[tuple[int, int]] = set()
            for n, e, r, starts, owners, keys, orders in sides:
                first, docs_of = _windows(own, offsets, n, False)
                # a window fits only if no more than e of its words are outside the items' words
                fit = outside[first + n] - outside[first] <= e
                first, docs_of = first[fit], docs_of[fit]
                if not len(first):
                    continue
                places: list[np.ndarray] = []
                for own_keys, sorted_keys, order in zip(Walk(n, r).keys(own, first), keys, orders, strict=True):
                    low, high = np.searchsorted(sorted_keys, own_keys, "left"), np.searchsorted(sorted_keys, own_keys, "right")
                    hit = np.flatnonzero(high > low)
                    many = (high - low)[hit]
                    at = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    places.append(np.repeat(hit, many) * len(starts) + order[at])
                met = np.unique(np.concatenate(places))
                w, c = met // len(starts), met % len(starts)
                for k in np.flatnonzero(_may_be_near(own, first[w], symbols, starts[c], n, e)).tolist():
                    pair = (int(docs_of[w[k]]), int(owners[c[k]]))
                    if pair not in pairs and near(own[first[w[k]] : first[w[k]] + n], symbols[starts[c[k]] : starts[c[k]] + n], e):
                        pairs.add(pair)
            if pairs:
                d, i = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), item_ids.take(pa.array(i))], schema.names)

    return spread(docs).mapInArrow(run, schema)


def _by_shuffle(docs: DataFrame, texts: DataFrame, walks: list[tuple[int, int, int]], largest: bool) -> DataFrame:
    """The same search with both sides' windows joined by their keys; hot keys of the items are spread over salts."""

    def keyed(df: DataFrame, name: str, all_sizes: bool) -> DataFrame:
        schema = T.StructType([T.StructField(name, df.schema[name].dataType), T.StructField("key", T.LongType()), T.StructField(f"{name}_words", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, offsets = words(batch.column(1))
                for n, _, r in walks:
                    starts, of = _windows(own, offsets, n, not all_sizes)
                    for k, keys in enumerate(Walk(n, r).keys(own, starts) if len(starts) else ()):
                        values = own[(starts[:, None] + np.arange(n)).ravel()].astype(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * n), pa.array(values))
                        named = arrowtext.mix(keys + np.uint64(n * 1000 + k)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(named), lists], schema.names)

        return spread(df).mapInArrow(run, schema)

    left = cut(keyed(texts, "item", not largest).distinct())
    right = keyed(docs, "doc", True)
    salt = F.pmod(F.xxhash64("item", "item_words"), F.lit(SALTS)).cast("int")
    repeated = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = left.groupBy("key").count().where(F.col("count") > SALTS).select("key")
    # few item windows share a key; only keys that many share are spread, and their documents' windows repeated
    plain = right.join(hot, "key", "left_anti").join(left.join(hot, "key", "left_anti"), "key")
    spread_out = repeated.join(hot, "key", "left_semi").join(left.withColumn("salt", salt), ["key", "salt"]).drop("salt")
    pairs = plain.select("doc", "item", "doc_words", "item_words").unionByName(spread_out.select("doc", "item", "doc_words", "item_words"))
    edits = {n: e for n, e, _ in walks}
    schema = T.StructType([docs.schema["doc"], texts.schema["item"]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [near(np.array(x), np.array(y), edits[len(x)]) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], schema.names)

    return pairs.mapInArrow(verify, schema)


def _may_be_near(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, n: int, edits: int) -> np.ndarray:
    """Which pairs of windows have all words but `edits` within `edits` places of their own, which an edit distance of `edits` needs."""
    out = np.zeros(len(a_starts), bool)
    step = max(1, 4_000_000 // (n * n))
    for k in range(0, len(a_starts), step):
        x = a[a_starts[k : k + step, None] + np.arange(n)]
        y = b[b_starts[k : k + step, None] + np.arange(n)]
        if edits:
            same = np.zeros(x.shape, bool)
            for d in range(-edits, edits + 1):
                lo, hi = max(0, d), min(n, n + d)
                same[:, lo:hi] |= x[:, lo:hi] == y[:, lo - d : hi - d]
            out[k : k + step] = same.sum(1) >= n - edits
        else:
            out[k : k + step] = (x == y).all(1)
    return out


def near(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether the word edit distance is at most edits."""
    if np.array_equal(a, b):
        return True
    if not edits:
        return False
    x, y = a.tolist(), b.tolist()
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (u != v))
        if min(row) > edits:
            return False
    return row[-1] <= edits
