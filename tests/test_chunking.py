import random

import numpy as np
import pytest

from quern.operators import chunking


def fold(lengths, size):
    """The plain fold: chunk numbers of pieces."""
    out, fill, number = [], 0, 1
    for n in lengths:
        for p in chunking.pieces_of(n, size):
            if fill and fill + p > size:
                number, fill = number + 1, 0
            fill += p
            out.append(number)
    return out


def shares(lengths, budget):
    """Equal shares, round after round."""
    taken, active = [0] * len(lengths), list(range(len(lengths)))
    while budget > 0 and active:
        share, left = max(1, budget // len(active)), []
        for i in active:
            if not budget:
                break
            n = min(share, lengths[i] - taken[i], budget)
            taken[i] += n
            budget -= n
            if taken[i] < lengths[i]:
                left.append(i)
        active = left
    return taken


def pages(spark, rows):
    return spark.createDataFrame([(s, k, k, "x" * n, None, "en") for k, (s, n) in enumerate(rows)], "site string, page_ord int, page_id long, text string, url string, language_hint string")


def test_pack_continues_a_fill():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        at = rng.randint(0, len(lengths))
        whole = fold(lengths, 30)
        _, fill = chunking.pack(np.array(lengths[:at], np.int64), 30)
        got, _ = chunking.pack(np.array(lengths[at:], np.int64), 30, fill)
        offset = (whole[at - 1] if at else 1) - (0 if fill else 0)
        want = [n - offset for n in whole[at:]]
        assert got.tolist() == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_over_segments_is_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randint(1, 250)) for _ in range(600)]
    got = chunking.packed_pages(pages(spark, rows), 100).collect()
    for site in ("hot", "a", "b"):
        own = [r.chunk_no for r in sorted((r for r in got if r.site == site), key=lambda r: (r.page_ord, r.piece_no))]
        assert own == fold([n for s, n in rows if s == site], 100)


@pytest.mark.parametrize("budget", [1, 7, 100, 5000])
def test_balanced_shares_are_the_rounds(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.choice("ab"), rng.randint(1, 60)) for _ in range(40)]
    got = {r.page_id: r.taken for r in chunking.balanced_shares(pages(spark, rows), budget).collect()}
    for site in "ab":
        own = [(k, n) for k, (s, n) in enumerate(rows) if s == site]
        want = shares([n for _, n in own], budget)
        assert [got.get(k, 0) for k, _ in own] == want


def test_selection(spark):
    df = pages(spark, [("s", 10)] * 4)
    packed = chunking.packed_pages(df, 10)
    assert [(r.chunk_no, r.strategy) for r in chunking.selected_chunks(packed, 50).orderBy("chunk_no").collect()] == [(1, "evenly_spaced_chunks"), (4, "evenly_spaced_chunks")]
    assert [r.chunk_no for r in chunking.selected_chunks(packed, None, 1).orderBy("chunk_no").collect()] == [1, 2, 3, 4]
    assert chunking.selected_chunks(packed).first().strategy == "all_chunks"
    with pytest.raises(ValueError):
        chunking.selected_chunks(packed, 50, 2)


def test_blank_null_and_empty_tables(spark):
    df = spark.createDataFrame([("s", 0, 1, None), ("s", 1, 2, ""), ("s", 2, 3, "  \n"), (None, 3, 4, " ab ")], "site string, page_ord int, page_id long, text string")
    assert [(r.site, r.page_id, r.length) for r in chunking.packed_pages(df, 10).collect()] == [("", 4, 2)]
    assert [r.length for r in chunking.packed_pages(df, 10, keep_white=True).collect()] == [4]
    assert chunking.packed_pages(df.limit(0), 10).count() == 0
    assert chunking.balanced_shares(df.limit(0), 10).count() == 0
