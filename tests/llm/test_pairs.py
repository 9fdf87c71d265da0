"""Splitting, formatting duplicates, repeated lines, token ids, leaks: against brute force and round trips."""

import random
import re
import string
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import dedup, leaks, lines, split, tokens

needs_tokenizer = pytest.mark.skipif(not Path(tokens.TOKENIZER).exists(), reason="no tokenizer file")


def texts(spark, *values):
    return spark.createDataFrame([(k, v, "extra", "extra2") for k, v in enumerate(values)], "id long, text string, piece string, ids string")


# splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n é", min_size=0, max_size=900))
def test_pieces_cover_the_text(text):
    stops = split.cuts(text, 100, 20, 50)
    at = 0
    rebuilt = ""
    for k, stop in enumerate(stops):
        start = max(0, at - 20) if k else 0
        assert stop - start <= 100
        rebuilt += text[at:stop]
        at = stop
    assert rebuilt == text


def test_pieces_share_the_overlap_and_end_at_boundaries(spark):
    rng = random.Random(1)
    body = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randint(5, 40))) for _ in range(120))
    rows = split.split_oversized(texts(spark, f"  {body}\n", "short", "", None, "   ", "x" * 13_000), "id", "text", 6000, 200).collect()
    own = sorted((r for r in rows if r.id == 0), key=lambda r: r.piece_no)
    assert [r.piece_no for r in own] == list(range(1, len(own) + 1)) and all(len(r.piece) <= 6000 for r in own)
    for a, b in zip(own, own[1:], strict=False):
        assert a.piece[-200:] == b.piece[:200]
        assert a.piece.endswith("\n")
    assert {r.id for r in rows} == {0, 1, 5}
    assert "".join(r.piece if r.piece_no == 1 else r.piece[200:] for r in sorted((r for r in rows if r.id == 5), key=lambda r: r.piece_no)) == "x" * 13_000
    assert [r.id for r in split.oversized(texts(spark, "y" * 6000 + "  ", "y" * 6001, None), "id", "text").collect()] == [1]


def test_edits_move_only_near_cuts():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(9000))
    a = {text[x - 40 : x] for x in split.cuts(text, 6000, 200, 3000)[:-1]}
    b_text = text[:500] + " inserted words " + text[500:]
    b = {b_text[x - 40 : x] for x in split.cuts(b_text, 6000, 200, 3000)[:-1]}
    assert len(a & b) >= len(a) - 2


# duplicates


def plain_form(value):
    keep = lambda s: "".join(c for c in s.lower() if c.isalpha() or c.isdigit())
    base, _, rest = value.partition("?")
    return keep(base) + "".join(sorted(x for x in map(keep, rest.split("&")) if x))


def test_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    forms = ["Acme", "ACME!", "a-c me", "http://x.test/?a=1&b=2", "http://x.test?b=2&&a=1", "http://x.test?a=1&b=3", "Äcme", "äcme.", "", None]
    rows = [(k, rng.choice(forms), rng.choice(forms), "e") for k in range(400)]
    df = spark.createDataFrame(rows, "ordinal int, name string, url string, first_id string")
    groups = defaultdict(list)
    for k, n, u, _ in rows:
        if n is not None and u is not None:
            groups[tuple(sorted((plain_form(n), plain_form(u))))].append(k)
    want = {(min(g), k) for g in groups.values() for k in g if k != min(g)}
    assert {(r.first_id, r.copy_id) for r in dedup.duplicates(df, "ordinal", ["name", "url"]).collect()} == want
    kept = {r.ordinal: r.n_copies for r in dedup.collapsed(df, "ordinal", ["name", "url"]).collect()}
    assert {min(g): len(g) for g in groups.values()} == {k: n for k, n in kept.items() if rows[k][1] is not None and rows[k][2] is not None}
    assert all(kept[k] == 1 for k, n, u, _ in rows if n is None or u is None)
    assert dedup.duplicates(df.limit(0), "ordinal", ["name", "url"]).count() == 0


def test_collapsed_rows_with_repeated_and_null_ids(spark):
    rows = [(1, "a", "u"), (1, "a", "u"), (2, "A!", "u"), (None, "b", "v"), (3, "B", "v."), (None, None, "x"), (7, "c", "w"), (7, "c", "w2")]
    got = dedup.collapsed(spark.createDataFrame(rows, "ordinal int, name string, url string"), "ordinal", ["name", "url"]).collect()
    assert sorted((r.ordinal or 0, r.name, r.n_copies) for r in got if r.name) == [(1, "a", 3), (3, "B", 2), (7, "c", 1), (7, "c", 1)]
    assert [r.n_copies for r in got if r.name is None] == [1]


def test_a_hot_group_stays_whole(spark):
    df = spark.range(60_000).selectExpr("CAST(id AS INT) AS ordinal", "CASE WHEN id % 2 = 0 THEN 'Hot Name' ELSE concat('n', id) END AS name", "CASE WHEN id % 2 = 0 THEN 'hot.test' ELSE concat('u', id) END AS url")
    assert dedup.duplicates(df, "ordinal", ["name", "url"]).count() == 29_999


# repeated lines


def plain_lines(rows, least):
    norm = lambda s: re.sub("[0-9]+", "0", " ".join(s.split()).lower())
    pages = defaultdict(set)
    where = defaultdict(list)
    for page, url, text in rows:
        if not url or text is None:
            continue
        host = re.sub(r"^www\.", "", re.sub(r"^https?://", "", url.lower()).split("/")[0].split(":")[0])
        for no, line in enumerate(text.split("\n"), 1):
            if line.strip():
                pages[host, norm(line)].add(page)
                where[host, norm(line)].append((page, no))
    return {x for k, ps in pages.items() if len(ps) >= least for x in where[k]}


@pytest.mark.parametrize("repeat", [False, True])
def test_repeated_lines_against_brute_force(spark, repeat):
    rng = random.Random(4)
    pool = ["Menu", "menu ", "Share this page 12", "share  this page 7", "By A, 1.2", "A very long legal notice of this site, all rights reserved 2020", "", "  ", "x"]
    rows = [(k // 2 if repeat else k, rng.choice(["http://WWW.a.test:80/x", "https://a.test", "http://b.a.test/", "", None]), rng.choice([None, *["\n".join(rng.choices(pool, k=5)) + "\r"] * 6])) for k in range(60)]
    if repeat:
        rows += rows[:5]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, text string, line string")
    got = Counter((r.page_id, r.line_no) for r in lines.repeated_lines(df, least=8, near=False).collect())
    assert set(got) == plain_lines(rows, 8)
    assert lines.repeated_lines(df.limit(0), near=False).count() == 0


@pytest.mark.parametrize("small", [500_000, -1])
def test_equal_lines_come_through_the_clusters(spark, monkeypatch, small):
    """Spellings of one line with different masks are one line, near ones of the same cluster aren't; without the clusters they are lost."""
    monkeypatch.setattr("quern.session.SMALL", small)
    monkeypatch.setattr(lines, "WANTED", small)
    byline = "Written by Ana Silva on 3.4.2021 for the readers of this long page"
    spelled = [byline, byline.upper(), byline.lower()]
    rows = [(k, "http://a.test", f"{spelled[k % 3]}\n{byline.replace('Ana Silva', 'Eva Sand')}" if k < 7 else spelled[k % 3]) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    got = lambda: {(r.page_id, r.line_no) for r in lines.repeated_lines(df, least=8, near=False).collect()}
    assert got() == plain_lines(rows, 8) == {(k, 1) for k in range(9)}
    monkeypatch.setattr(lines, "mask_clusters", lambda *_, **__: spark.createDataFrame([], "mask long, cluster long"))
    assert got() == set()


NAMES = ["Ana Silva", "João Lima", "Marie Dupont", "Hans Vogel", "Rosa Conti", "Peter Brown", "Lena Moll", "Tom Reed", "Eva Sand", "Ivo Prat"]


def test_near_lines_go_together(spark):
    bylines = [f"By {n}, {3 + k} {'March April May June'.split()[k % 4]} 20{20 + k % 5}" for k, n in enumerate(NAMES)]
    rows = [(k, "http://a.test", f"what stands on page {'abcdefghij'[k]} alone\n{bylines[k]}\n{n} | {k} | 12") for k, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    assert lines.repeated_lines(df, least=8, near=False).count() == 0
    assert {(r.page_id, r.line_no) for r in lines.repeated_lines(df, least=8, near=True).collect()} == {(k, 2) for k in range(10)}
    cut = lines.without_lines(df, spark.createDataFrame([(0, 2), (0, 1), (0, 3), (1, 1)], "page_id long, line_no int"))
    got = {r.page_id: r.text for r in cut.collect()}
    assert got[0] == "" and got[1].startswith("By") and got[2] == rows[2][2]


@pytest.mark.parametrize(("line", "mask"), [("Von Hans Vogel, 3. März 2024", "von # 0"), ("Publicado em 12 de março de 2024 por João Lima", "publicado em 0 por #"), ("HOME", "home"), ("Read more. Then Ana left", "read more. then # left"), ("March 3rd, 2024 – 10:30", "0 – 0"), ("Maria Silva 12", "# 0"), ("", "")])
def test_masks(line, mask):
    assert " ".join(lines.masked(line)) == mask


def test_a_line_near_to_a_line_that_joined_another_one(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    other = lambda n: " ".join(words[: 60 - n] + [f"z{chr(97 + k)}" for k in range(n)])
    # by 5-word runs: 56 each; other(0) and other(5), other(5) and x are near, other(0) and x aren't
    x = " ".join([f"y{chr(97 + k)}" for k in range(5)] + words[5:55] + [f"z{chr(97 + k)}" for k in range(5)])
    texts = [other(0)] * 6 + [other(5)] * 5 + [x] * 4 + ["a wholly different line that stands on a few pages of the same host only"] * 4
    df = spark.createDataFrame([(k, "http://a.test", t) for k, t in enumerate(texts)], "page_id long, url string, text string")
    assert {(r.page_id, r.line_no) for r in lines.repeated_lines(df, least=8, near=True).collect()} == {(k, 1) for k in range(15)}


@pytest.mark.parametrize("block", [256, 7])
def test_clusters_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(400)]
    pool = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=64)
        for _ in range(14):
            changed = list(rng.choice(pool[-3:]).split() if pool and rng.random() < 0.5 and pool[-1].split()[40:50] == base[40:50] else base)
            for _ in range(rng.randint(0, 2)):
                changed[rng.choice([rng.randrange(40), rng.randrange(50, 64)])] = rng.choice(vocabulary)
            pool.append(" ".join(changed))
    pool = sorted(set(pool))
    df = spark.createDataFrame([(k * 10 + j, "http://a.test", x) for k, x in enumerate(pool) for j in range(rng.randint(1, 3))], "page_id long, url string, text string")
    sets = lines._written(lines.signatures(df, "page_id", "url", "text"))
    runs = lines._run_sets(df, "page_id", "url", "text")
    known = {r["mask"]: set(r["runs"]) for r in runs.collect()}
    assert len(known) == len(pool) == sets.count()
    label = {k: k for k in known}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, s in known.items():
        for c, t in known.items():
            if len(s & t) >= 0.8 * len(s | t):
                label[root(a)] = root(c)
    want, got = defaultdict(set), defaultdict(set)
    for k in known:
        want[root(k)].add(k)
    for r in lines.mask_clusters(sets, runs).collect():
        got[r.cluster].add(r["mask"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert max(map(len, got.values())) > 5


def test_recall_of_the_buckets_at_the_threshold(spark):
    """Pairs of masks whose similarity is just 0.8 share a bucket in at least 0.95 of the cases."""
    rng = random.Random(12)
    rows, truth = [], 0
    for k in range(150):
        base = ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(58)]
        other = list(base)
        other[:6] = ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(6)]  # 48 of 60 runs are shared
        rows += [(2 * k, "http://a.test", " ".join(base)), (2 * k + 1, "http://a.test", " ".join(other))]
        truth += 1
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    sets = lines._written(lines.signatures(df, "page_id", "url", "text"))
    assert lines.mask_clusters(sets, lines._run_sets(df, "page_id", "url", "text")).count() >= 0.95 * 2 * truth


def test_components_of_chains_and_stars(spark):
    edges = [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)] + [("s50", f"s{k:02}") for k in range(30)] + [("x", "x"), ("p", "q"), ("q", "p")]
    got = {r.id: r.label for r in lines.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"c{k:02}": "c00" for k in range(41)}, **{f"s{k:02}": "s00" for k in (*range(30), 50)}, "p": "p", "q": "p"}
    assert lines.components(spark.createDataFrame([], "a string, b string")).count() == 0


# tokens


@needs_tokenizer
def test_ids_are_the_library_s_and_decode_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    values = ["Hello world", "a  b\n\n c", "<|endoftext|> x", "ção naïve — “q”", "東区仓库 👩‍⚕️ ", "​﻿ x", "I'll we've 12345", "\x00\x7f", " " * 50, "é"]
    df = texts(spark, *values, "", None)
    got = {r.id: r.ids for r in tokens.encode(df, "id", "text").collect()}
    assert [got[k] for k in range(len(values))] == [t.encode(v, add_special_tokens=False).ids for v in values]
    assert got[len(values)] == [] and got[len(values) + 1] == []
    back = {r.id: r.text for r in tokens.decode(tokens.encode(df, "id", "text"), "id", "ids").collect()}
    assert [back[k] for k in range(len(values) + 2)] == [*values, "", ""]


@needs_tokenizer
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does(text):
    e = tokens._encoder(tokens.TOKENIZER)
    assert e.ids(text) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(e.token_bytes()[i] for i in e.ids(text)).decode() == text


@needs_tokenizer
def test_offsets_point_into_the_bytes(spark):
    text = "né 👩 ok"
    row = tokens.encode_with_offsets(texts(spark, text), "id", "text").first()
    table = tokens._encoder(tokens.TOKENIZER).token_bytes()
    assert all(text.encode()[s:e] == table[i] for i, s, e in zip(row.ids, row.starts, row.ends, strict=True))
    assert row.char_starts[0] == 0 and row.char_starts[-1] == text.index(" ok") or row.char_starts[-1] == len(text) - 3


# leaks


def plain_leaks(docs, items, least):
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    grams = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    own = {i: grams(words(t)) for i, t in items if t}
    return {(d, i) for d, t in docs if t for i, g in own.items() if g & grams(words(t))}


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for k in range(25)] + [(90, None), (91, "")]
    docs = []
    for k in range(120):
        body = rng.choices(vocabulary + ["other", "words"], k=40)
        if k % 3 == 0:
            source = rng.choice(items[:25])[1].split()
            cut = rng.randint(0, max(0, len(source) - 10))
            body[10:10] = source[cut : cut + rng.randint(8, 12)]
        docs.append((k, rng.choice([" ", "\n", "; ", " – "]).join(w.upper() if rng.random() < 0.2 else w for w in body)))
    docs += [(500, None), (501, "  "), docs[0]]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string").select("doc_id", "text")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.leaked(d, i).collect()]
    assert set(got) == plain_leaks(docs, items, 10) and len(got) == len(set(got))
    assert leaks.leaked(d, i.limit(0)).count() == 0 and leaks.leaked(d.limit(0), i).count() == 0


def test_leaks_by_a_shuffle_and_with_edits(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, "so " + item), (2, item.replace("six", "SIXTH"))], "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, item + " more")], "item_id long, text string")
    for size in (0, 64 << 20):
        monkeypatch.setattr(leaks, "BROADCAST_BYTES", size)
        assert {tuple(r) for r in leaks.leaked(d, i).collect()} == {(1, 1), (1, 2)}
        assert {tuple(r) for r in leaks.leaked(d, i, edits=1).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_planted_edits_are_found(spark):
    """Items of 30 words with two word edits inside longer documents: recall, and no row that brute force doesn't give."""
    import numpy as np

    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(600)]
    items = [(k, " ".join(rng.choice(vocabulary, 30))) for k in range(60)]
    docs = []
    for k, text in items:
        own = text.split()
        for _ in range(2):
            at = int(rng.integers(len(own)))
            own = [own[:at] + ["zz"] + own[at + 1 :], own[:at] + ["zz"] + own[at:], own[:at] + own[at + 1 :]][int(rng.integers(3))]
        docs.append((k, " ".join([*rng.choice(vocabulary, 40), *own, *rng.choice(vocabulary, 40)])))
    docs += [(1000 + k, " ".join(rng.choice(vocabulary, 120))) for k in range(60)]
    got = {tuple(r) for r in leaks.near_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def true(doc, text):
        a, b = np.array(doc.split()), np.array(text.split())
        return any(leaks.near(a[x : x + 28], b[y : y + 28], 2) for x in range(len(a) - 27) for y in range(3) if len(np.intersect1d(a[x : x + 28], b[y : y + 28])) > 20)

    assert {(k, k) for k, _ in items} >= got and len(got) >= 0.95 * sum(true(docs[k][1], t) for k, t in items)
    assert leaks.shared_rate(28, 2) > 0.2 and leaks.repetitions_for(0.99, 28, 0) == 1
