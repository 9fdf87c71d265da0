"""Fits the models of this subpackage: python -m quern.llm.train FOLDER_OF_TABLES.

It reads a bounded sample of rows, SAMPLE documents and SAMPLE pages (the smallest ids first), and the labelled lines in
models/lines.txt, and writes models/lines.npz, models/lang.npz, models/words.txt (non-ASCII words) and models/prose_XX.txt.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np

from quern.llm import language, linemodel

#: Rows of each table that the models are fitted on at most.
SAMPLE = 16_000
#: Sources or sites that a word must stand in to be no name.
SOURCES = 8
#: Bytes of prose in a language's compression dictionary.
PROSE_BYTES = 24_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Signs that prose of the six languages doesn't hold; texts with one are left out of the samples.
_ODD = re.compile("[^\x00-~àáâãäçèéêëìíîïñòóôõöùúûüßœÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜŒ«»“”„’–€£°ºª¿¡…]|Ã[^A-ZÇÕ]|Â[^A-ZÇÕ]|â€")


#: Grammatical combinations taken of each language, at most.
GRAMMAR = 1_500
#: Words that stand with the public dummy copy in a sentence of the sample, so many times and in so much of all their sentences, are dummy words too.
DUMMY_TIMES, DUMMY_SHARE, ROUNDS = 3, 0.5, 4


def dummy_words(texts) -> set[str]:  # noqa: ANN001
    """The words of the public dummy copy, and those that make up sentences of the sample together with it."""
    rows = [x.split("\t")[1].split() for x in (linemodel.MODELS / "lines.txt").read_text(encoding="utf-8").split("\n") if x.startswith("D\t")]
    words = {w for r in rows for w in r if len(w) > 3}
    for _ in range(ROUNDS):
        beside: Counter = Counter()
        total: Counter = Counter()
        for t in texts:
            for s in [s for line in t.split("\n") for s in _SENTENCE.split(line)]:
                own = re.findall("[a-z]+", s.lower())
                total.update(set(own))
                if len(own) > 5 and sum(w in words for w in own) >= 0.12 * len(own):
                    beside.update(set(own))
        words |= {w for w, c in beside.items() if c >= DUMMY_TIMES and c >= DUMMY_SHARE * total[w] and len(w) > 3}
    return words


def labelled(dummy: set[str], without: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(class, line) of the labelled lines, with the lines the grammar of messages gives and those that go with a page's marks.

    Phrases in `without` are left out, for tests on unseen phrases.
    """
    out: list[tuple[str, str]] = []
    grammar: dict = defaultdict(lambda: defaultdict(list))
    for row in (linemodel.MODELS / "lines.txt").read_text(encoding="utf-8").split("\n"):
        if not row or row.startswith("#"):
            continue
        kind, *rest = row.split("\t")
        phrases = [x for x in rest[-1].split(" ¦ ") if x not in without]
        if kind in linemodel.CLASSES and len(rest) == 1:
            out += [(kind, x) for x in phrases]
        elif len(rest) == 2:
            grammar[rest[0]][kind] += phrases
    rng, n_own = random.Random(5), len(out)
    for g in grammar.values():
        own = []
        for s, v in product(g["S"], g["V"]):
            own.append(f"{s} {v}")
            own += [f"{s} {v}{rng.choice(['.', '!', ' –', ':'])} {a}{rng.choice(['.', '', '!', ' :('])}" for a in rng.sample(g["A"], min(3, len(g["A"])))]
        for j, k in product(g["J"], g["K"]):
            own.append(f"{j} {k}")
            own += [f"{j} {k}{rng.choice([' –', '', ','])} {x}." for x in g["L"]]
        out += [("M", x) for x in rng.sample(own, min(GRAMMAR, len(own))) + g["A"]]
    out += 5 * out[:n_own]
    titles = [x for c, x in out if c == "T"]
    items = [x for c, x in out if c == "F" and len(x.split()) <= 3 and x[-1] not in "?!.*" and "NAME" not in x and "0" not in x]
    homes = ["Home > Insights", "Início > Notícias", "Inicio > Noticias", "Accueil > Actualités", "Startseite > Aktuelles", "Pagina iniziale > Notizie"]
    for t in titles:
        out += [("F", f"{h} > {t}".replace(" > ", s)) for h in homes for s in (" > ", " / ", " » ")]
        out += [("T", f"{t} NAME"), ("T", t)]
    for _ in range(2500):
        k = rng.randint(1, 9)
        out.append(("F", rng.choice([" | ", " / ", " · ", " > ", "  ", " "]).join(rng.sample(items, k))))
    for x in items:
        out += [("F", b + x) for b in ("• ", "> ", "» ", "", "- ", "", "", "")] * 2
    for x in [x for c, x in out if c == "C"]:
        out += [("C", b + x) for b in ("- ", "* ", "• ", "0) ", "NAME – ", "")]
    for _ in range(400):
        out.append(("M", " ".join(rng.choices(sorted(dummy), k=rng.randint(4, 30))) + "."))
    for _ in range(300):
        out.append(("C", rng.choice([" | ", "; ", "  "]).join(rng.choices(["NAME", "NAME NAME", "0", "0.0", "-"], k=rng.randint(3, 6)))))
    signs = str.maketrans(dict.fromkeys("–—·©’…", " "))
    out += [(c, x.translate(signs)) for c, x in out if c in "FPBT" and x.translate(signs) != x]
    # a line is classified as a whole and by its parts
    out += [(c, s) for c, x in out if c in "MFPB" for s in _SENTENCE.split(x) if len(s.split()) > 2 and s != x]
    marks = ["* ", "### ", "[!] ", "! ", ""]
    out += [("M", rng.choice(marks) + x + rng.choice(["", "...", " :(", " #0", "!!"])) for c, x in out if c == "M"]
    return out


def softmax_fit(rows: list[list[int]], labels: np.ndarray, n_features: int, n_classes: int, weight: np.ndarray, steps: int = 220, rate: float = 0.5, decay: float = 2e-5) -> np.ndarray:
    """Weights of a softmax regression by Adam over all rows."""
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate([np.array(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = np.repeat(np.arange(len(rows)), sizes)
    w = np.zeros((n_features, n_classes))
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(n_classes)[labels]
    order = np.argsort(cols, kind="stable")
    sorted_cols, firsts = np.unique(cols[order], return_index=True)
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[cols], starts)
        z = np.exp(z - z.max(1, keepdims=True))
        e = (z / z.sum(1, keepdims=True) - hot) * weight[:, None]
        g = np.zeros_like(w)
        g[sorted_cols] = np.add.reduceat(e[of][order], firsts)
        g = g / weight.sum() + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_lines(prose: list[str], words: Counter, dummy: set[str], folder: Path, without: frozenset[str] = frozenset()) -> None:
    data = labelled(dummy, without) + [("C", s) for s in prose]
    vocabulary = {t for _, x in data[: len(data) - len(prose)] for t in re.findall("[a-z]+", linemodel.fold(x.replace("NAME", "")))}
    vocabulary |= {w for w, c in words.items() if c >= 25} | dummy
    vocabulary = frozenset(vocabulary)
    data = [(c, re.sub(r"NAME(?![a-z])", "Qq", x)) for c, x in data]
    feats = [linemodel.features(linemodel.tokens(x, vocabulary)) for _, x in data]
    counts = Counter(f for fs in feats for f in set(fs))
    index = {f: k for k, f in enumerate(sorted(counts))}
    rows = [[index[f] for f in fs] for fs in feats]
    labels = np.array([linemodel.CLASSES.index(c) for c, _ in data])
    share = np.bincount(labels, minlength=len(linemodel.CLASSES))
    weight = 1 / np.sqrt(share[labels])
    w = softmax_fit(rows, labels, len(index), len(linemodel.CLASSES), weight)
    kept = np.flatnonzero(np.abs(w).max(1) > 0.02)
    names = np.array(sorted(index))[kept]
    np.savez_compressed(folder / "lines.npz", vocabulary=np.array(sorted(vocabulary)), features=names, weights=w[kept].astype(np.float16))
    print("lines", len(data), "features", len(kept))


def hinge_fit(rows: list[np.ndarray], sign: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a linear support vector machine by averaged subgradient steps over shuffled rows (Pegasos)."""
    rng = np.random.default_rng(1)
    w, total, decay, t = np.zeros(language.DIMENSIONS), np.zeros(language.DIMENSIONS), 1e-4, 0
    scale = 1.0
    for _ in range(max(1, steps // 15)):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (decay * (t + 2000))
            at, value = rows[i]
            margin = sign[i] * scale * (w[at] * value).sum()
            scale *= 1 - rate * decay
            if margin < 1:
                w[at] += sign[i] * rate * value / scale
        total += w * scale
    return total / max(1, steps // 15)


def fit_language(sentences: list[tuple[str, str]], held: list[tuple[str, str]]) -> None:
    rows = []
    for _, s in sentences:
        bag: Counter = Counter()
        words = language.WORD.findall(linemodel.fold(s))
        for w in words:
            at = language.word_features(w)
            for x in at:
                bag[x] += 1 / np.sqrt(len(at)) / len(words)
        rows.append((np.fromiter(bag, np.int64), np.fromiter(bag.values(), float)))
    langs = np.array([x for x, _ in sentences])
    columns = [hinge_fit(rows, np.where(np.isin(langs, language.FAMILIES["romance"]), 1, -1))]
    for a, b in language.PAIRS:
        keep = np.flatnonzero((langs == a) | (langs == b))
        columns.append(hinge_fit([rows[i] for i in keep], np.where(langs[keep] == a, 1, -1)))
    weights = np.stack(columns, 1).astype(np.float16)
    # slopes that turn margins to confidence, and its errors, from sentences the weights weren't fitted on
    held = [(x, s) for x, s in held if language.WORD.findall(linemodel.fold(s))]
    np.savez_compressed(language.MODELS / "lang.npz", weights=weights)
    m = language.LanguageModel()
    scores = np.stack([m.score(language.WORD.findall(linemodel.fold(s))) for _, s in held])
    truth = np.array([language.LANGUAGES.index(x) for x, _ in held])
    best = None
    for slopes in product((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), repeat=2):
        m.slopes = list(slopes)
        lang, sure = m.decide(scores)
        loss = -np.where(lang == truth, np.log(np.maximum(sure, 1e-6)), np.log(np.maximum(1 - sure, 1e-6))).mean()
        if best is None or loss < best[0]:
            best = (loss, slopes, (lang == truth).mean(), abs(sure.mean() - (lang == truth).mean()))
    np.savez_compressed(language.MODELS / "lang.npz", weights=weights, slopes=np.array(best[1]))
    print("language, on", len(held), "held-out sentences: log loss, slopes, right, |confidence - right|:", best)


def usual(texts) -> set[str]:  # noqa: ANN001
    """The non-ASCII words that are the usual spelling of their pattern; a garbled spelling is rare beside the right one."""
    counts = Counter(w for t in texts for w in language.WORD.findall(t.lower()) if not w.isascii())
    most: Counter = Counter()
    for w, c in counts.items():
        pattern = re.sub(r"[^\x00-\x7f]", "?", w)
        most[pattern] = max(most[pattern], c)
    return {w for w, c in counts.items() if c >= 5 and c >= 0.2 * most[re.sub(r"[^\x00-\x7f]", "?", w)]}


def sample(folder: str) -> tuple:
    """(documents, pages) of the smallest ids, SAMPLE rows of each at most."""
    import pyarrow.parquet as pq

    documents = pq.read_table(Path(folder) / "documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pandas().sort_values("doc_id").head(SAMPLE)
    pages = pq.read_table(Path(folder) / "evidence.parquet", columns=["page_id", "text", "site"]).to_pandas().sort_values("page_id").head(SAMPLE)
    return documents.dropna(subset=["text"]), pages.dropna(subset=["text"])


def clean_sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.split(" ".join(text.split())) if 30 < len(x) < 400 and x[-1] in ".!?" and not _ODD.search(x)]


def parts_of_sample(documents, pages) -> dict:  # noqa: ANN001
    """What the models are fitted on: sentences by language, paragraphs, word counts, prose, dummy words."""
    rng = random.Random(3)
    dummy = dummy_words(pages.text)
    by_lang: dict[str, list[str]] = defaultdict(list)
    for text, lang in zip(documents.text, documents.lang, strict=True):
        if lang in language.LANGUAGES:
            by_lang[lang] += [s for s in clean_sentences(text) if len(s) < 300 and s[0].isupper() and "�" not in s and len(s.split()) >= 4]
    words = Counter(w for ss in by_lang.values() for s in ss for w in re.findall("[a-z]+", linemodel.fold(s)))
    # nouns of one language are in capitals, so a word is a name if it is so in all the others
    plain = Counter(w for x, ss in by_lang.items() if x != "de" for s in ss for w in re.findall(r"(?<= )\w+", s) if w.islower())
    capital = Counter(linemodel.fold(w) for x, ss in by_lang.items() if x != "de" for s in ss for w in re.findall(r"(?<= )\w+", s) if w[0].isupper())
    names = {w for w, c in capital.items() if c >= 3 and not plain[w]}
    # names stand in few sources or sites
    spread: dict[str, set] = defaultdict(set)
    for text, source in [*zip(documents.text, documents.source, strict=True), *zip(pages.text, pages.site, strict=True)]:
        for w in set(re.findall("[a-z]+", linemodel.fold(text))):
            spread[w].add(source)
    # paragraphs of pages in several sentences, without slots, messages' phrases and dummy copy
    phrases = {x for row in (linemodel.MODELS / "lines.txt").read_text(encoding="utf-8").split("\n") if row[:1] in "MFBP" for x in row.split("\t")[-1].split(" ¦ ") if len(x) > 15}
    paragraphs = [p for t in pages.text for p in t.split("\n") if len(p) > 150 and p.count(". ") > 1 and not _ODD.search(p) and not linemodel.SLOT.search(p)]
    paragraphs = [p for p in paragraphs if not any(x in p for x in phrases) and sum(w in dummy for w in p.lower().split()) < 0.1 * len(p.split())]
    words.update(w for p in paragraphs for w in re.findall("[a-z]+", linemodel.fold(p)))
    words = Counter({w: c for w, c in words.items() if len(spread[w]) >= SOURCES and w not in names})
    prose = rng.sample(paragraphs, min(3000, len(paragraphs)))
    prose = [s for p in prose for s in rng.sample(_SENTENCE.split(p), 2)] + prose[:600]
    for ss in by_lang.values():
        prose += rng.sample(ss, min(600, len(ss)))
    return {"by_lang": by_lang, "words": words, "paragraphs": paragraphs, "prose": prose, "dummy": dummy}


def main(folder: str) -> None:
    documents, pages = sample(folder)
    own = parts_of_sample(documents, pages)
    by_lang, words, paragraphs = own["by_lang"], own["words"], own["paragraphs"]
    fit_lines(own["prose"], words, own["dummy"], linemodel.MODELS)
    rng = random.Random(4)
    rows = [(x, s) for x, ss in by_lang.items() for s in rng.sample(ss, min(3500, len(ss)))]
    rng.shuffle(rows)
    cut = len(rows) * 5 // 7
    seen = {s for _, s in rows[:cut]}
    fit_language(rows[:cut], [r for r in rows[cut:] if r[1] not in seen])
    common = {w for w, c in words.items() if c >= 8}
    raw: dict[str, list[str]] = defaultdict(list)
    for text, lang in zip(documents.text, documents.lang, strict=True):
        if lang in language.LANGUAGES:
            raw[lang] += clean_sentences(text)
    clean = set().union(usual(paragraphs), *(usual(ss) for ss in raw.values()))
    (linemodel.MODELS / "words.txt").write_text("\n".join(sorted(clean)), encoding="utf-8")
    print("non-ASCII words", len(clean))
    for lang in sorted(by_lang):
        seen: set[str] = set()
        out, size = [], 0
        for s in raw[lang] + [x for p in paragraphs for x in _SENTENCE.split(p) if language.model().detect(x)[0] == lang]:
            s = re.sub(r"^\W+", "", s)
            words_of = language.WORD.findall(s.lower())
            if linemodel.SLOT.search(s) or any(not w.isascii() and w not in clean for w in words_of):
                continue
            # what adds a word, or a non-ASCII sign in a new place
            new = {w for w in words_of if linemodel.fold(w) in common} | {re.sub(r"[0-9]+", "0", re.sub("[^\\W\\d_]{4,}", "x", w)) for w in s.split() if not w.isascii()}
            new -= seen
            if new and size + len(s.encode()) < PROSE_BYTES:
                out.append(s)
                seen |= new
                size += len(s.encode())
        (linemodel.MODELS / f"prose_{lang}.txt").write_text("\n".join(out), encoding="utf-8")
        print(lang, len(out), size)


if __name__ == "__main__":
    main(sys.argv[1])
