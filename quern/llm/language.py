"""Problem 5: languages of documents and segments, by a family decision and one-versus-one linear machines inside the family.

The features of a sentence are its words' letter runs; a word's scores are computed once and a sentence's score is their mean.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm import linemodel, pages, residue
from quern.llm.linemodel import fold

MODELS = Path(__file__).parent / "models"
FAMILIES = {"romance": ("pt", "es", "fr", "it"), "germanic": ("en", "de")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
PAIRS = tuple(p for f in FAMILIES.values() for p in combinations(f, 2))
DIMENSIONS = 1 << 14
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose scores a task keeps; at the bound it starts afresh, which changes speed alone.
WORDS = 100_000


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its runs of one to four letters, its edges marked."""
    edged = f"<{word}>"
    runs = {edged[i : i + n] for n in (1, 2, 3, 4) for i in range(len(edged) - n + 1)}
    return [zlib.crc32(r.encode()) % DIMENSIONS for r in (*runs, f"={word}")]


class LanguageModel:
    """Column 0 of the weights decides the family (positive: the first), the others the PAIRS (positive: the first)."""

    def __init__(self, path: Path = MODELS / "lang.npz") -> None:
        with np.load(path) as data:
            self.weights = data["weights"].astype(np.float32)
            self.slopes = data["slopes"].tolist() if "slopes" in data else [4.0, 4.0]
        self.words: dict[str, np.ndarray] = {}

    def word_score(self, word: str) -> np.ndarray:
        at = word_features(word)
        return self.weights[at].sum(0) / np.sqrt(len(at))

    def score(self, found: list[str]) -> np.ndarray:
        """The mean scores of folded words."""
        if len(self.words) + len(found) > WORDS:
            self.words.clear()
        for w in found:
            if w not in self.words:
                self.words[w] = self.word_score(w)
        return np.mean([self.words[w] for w in found], 0)

    def decide(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in LANGUAGES, confidence in [0, 1]) for rows of scores: the family first, then the pairs of the family vote.

        A vote counts one, and close counts go by the margins; the confidence is that of the family times that of the least sure
        pair the winner won.
        """
        n = len(scores)
        wins, least = np.zeros((n, len(LANGUAGES))), np.full((n, len(LANGUAGES)), np.inf)
        rows = np.arange(n)
        for k, (a, b) in enumerate(PAIRS, 1):
            margin = np.abs(scores[:, k])
            won = np.where(scores[:, k] > 0, LANGUAGES.index(a), LANGUAGES.index(b))
            wins[rows, won] += 1 + np.minimum(1.0, margin) / 100
            least[rows, won] = np.minimum(least[rows, won], margin)
        romance = np.isin(LANGUAGES, FAMILIES["romance"])
        wins[romance[None, :] != (scores[:, :1] > 0)] = -1
        best = wins.argmax(1)
        pair = np.where(np.isfinite(least[rows, best]), least[rows, best], 0)
        logistic = lambda x, slope: 1 / (1 + np.exp(-slope * np.minimum(30.0, x)))
        sure = logistic(np.abs(scores[:, 0]), self.slopes[0]) * logistic(pair, self.slopes[1])
        return best, np.where(np.any(scores != 0, 1), sure, 0.0)

    def detect(self, sentence: str) -> tuple[str, float]:
        """(language, confidence in [0, 1]); ("und", 0) for a text without letters."""
        found = WORD.findall(fold(sentence))
        if not found:
            return "und", 0.0
        best, sure = self.decide(self.score(found)[None, :])
        return LANGUAGES[best[0]], float(sure[0])


@lru_cache(maxsize=1)
def model() -> LanguageModel:
    return LanguageModel()


_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"|‘[^‘’]{12,}’(?!\w)")
_MARK = re.compile("[“„«\"‘]")
#: Words that a sentence must have to tell its language, and known words below which its unknown ones count too.
LEAST_WORDS, LEAST_KNOWN = 4, 3
#: How sure a sentence must be to be main text.
MAIN = 0.4
#: A sentence less sure of its language than this goes with the sure sentences beside it.
SURE = 0.8


def unquoted(text: str) -> str:
    """text without what stands in quotation marks, quotations inside quotations included."""
    while _MARK.search(text) and (plain := _QUOTED.sub(" ", text)) != text:
        text = plain
    return text


def sentence_segments(texts: pa.Array) -> tuple[linemodel.Segments, np.ndarray, np.ndarray]:
    """(sentences of texts outside quotation marks, whether each is closed by a sentence sign, and the text's words by sentence)."""
    hits = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _MARK.pattern)))
    if len(hits):
        plain = texts.to_pylist()
        for k in hits.tolist():
            plain[k] = unquoted(plain[k])
        texts = pa.array(plain, pa.string())
    text, word = linemodel.split_words(texts)
    flags = linemodel.flags_of(word)
    begins = np.zeros(len(word), bool)
    if len(word):
        ends = (flags & linemodel.CLOSE > 0) & (flags & linemodel.SHORT == 0)
        begins[1:] = ends[:-1] & (flags[1:] & linemodel.START > 0)
    seg = linemodel.Segments.of_words(text, word, begins)
    # closed: the last word that isn't a bare sign ends in a sentence sign
    segment = np.repeat(np.arange(len(seg)), seg.n_words)
    real = np.flatnonzero((flags & linemodel.SYMBOL == 0) | (flags & linemodel.CLOSED > 0))
    last = np.full(len(seg), -1)
    last[segment[real]] = real
    closed = (last >= 0) & (flags[last] & linemodel.CLOSED > 0) if len(word) else np.zeros(len(seg), bool)
    return seg, closed, np.asarray(word)


@lru_cache(maxsize=1)
def _token_scores() -> tuple[np.ndarray, np.ndarray]:
    """(scores of each token of the line model, whether it is a known word)."""
    m, lines = model(), linemodel.model()
    known = lines.alpha.copy()
    known[lines.number["N"]] = False
    scores = np.zeros((len(lines.names), m.weights.shape[1]), np.float32)
    for k in np.flatnonzero(known).tolist():
        scores[k] = m.word_score(lines.names[k])
    return scores, known


def detected(seg: linemodel.Segments) -> tuple[np.ndarray, np.ndarray]:
    """(place in LANGUAGES, confidence) of each segment, from its known words; from all its words where those are few."""
    scores, known = _token_scores()
    own = known[seg.tok]
    n = np.bincount(seg.of[own], minlength=len(seg))
    sums = np.zeros((len(seg), scores.shape[1]), np.float32)
    tok, of = seg.tok[own], seg.of[own]
    if len(tok):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums[of[first]] = np.add.reduceat(scores[tok], first, axis=0)
    mean = sums / np.maximum(n, 1)[:, None]
    few = np.flatnonzero(n < LEAST_KNOWN)
    if len(few):
        spelled = list(linemodel.words().index)
        for k in few.tolist():
            found = WORD.findall(fold(" ".join(spelled[w] for w in seg.word[seg.start[k] : seg.start[k] + seg.n_words[k]].tolist())))
            if found:
                mean[k] = model().score(found)
    return model().decide(mean)


class Body:
    """The sentences of the pages' main bodies, in order, garbled ones as restored.

    Bylines, share prompts, disclaimers and messages don't count.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.a = a = pages.Analysis.of(pages.restored(texts))
        lines = a.distinct
        content = (a.kind == pages._C) & ~a.furniture
        used = np.zeros(len(lines.lines), bool)
        used[a.code[content]] = True
        chosen = np.flatnonzero(used)
        plain = pc.replace_substring(lines.plain.take(pa.array(chosen)), linemodel.SLOT_MARK, " ")
        seg, closed, _ = sentence_segments(plain)
        main = closed & (seg.n_words >= LEAST_WORDS) & (seg.alpha >= LEAST_WORDS) & (np.maximum(seg.p[:, pages._C], seg.p[:, pages._T]) > MAIN)
        lang, sure = detected(seg)
        # sentences of each distinct line, then of each line of a page
        keep = np.flatnonzero(main)
        first = np.searchsorted(chosen[seg.text[keep]], np.arange(len(lines.lines) + 1))
        at = np.flatnonzero(content)
        n = np.diff(first)[a.code[at]]
        rows = np.repeat(first[a.code[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.line = np.repeat(at, n)
        self.page = a.page[self.line]
        self.lang, self.sure = lang[keep[rows]].copy(), sure[keep[rows]]
        self._beside()
        # the same segments for every distinct line, main or not, for segments()
        self.chosen, self.seg, self.main, self.own_lang = chosen, seg, main, lang

    def _beside(self) -> None:
        """Sentences that aren't sure take the language that most of the sure ones up to two places away have."""
        was = self.lang.copy()
        for k in np.flatnonzero(self.sure < SURE).tolist():
            near = [j for j in range(max(0, k - 2), min(len(was), k + 3)) if j != k and self.page[j] == self.page[k] and self.sure[j] >= SURE]
            beside = [int(self.lang[j]) if j < k else int(was[j]) for j in near]
            if beside and was[k] not in beside:
                self.lang[k] = max(set(beside), key=lambda x: (beside.count(x), LANGUAGES[x]))

    def counted(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, language, mean confidence) of each language with at least so many sentences, by page."""
        keys = self.page * len(LANGUAGES) + self.lang
        pairs, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        sure = np.bincount(back, self.sure, len(pairs)) / np.maximum(n, 1)
        enough = n >= least
        return pairs[enough] // len(LANGUAGES), pairs[enough] % len(LANGUAGES), sure[enough]


def page_languages(df: DataFrame, id_col: str, text_col: str, hint_col: str | None = None, least: int = 2) -> DataFrame:
    """Rows (id, lang, confidence, hint_is_right) for each language of each text's main body.

    A language needs at least `least` sentences outside quotation marks. A hint is right if its part before the first - or _, in
    any case, is the only language. Texts without such sentences, null and blank ones and pages of residue give no rows.
    """

    def rows(texts: pa.Array, hints: pa.Array | None = None) -> tuple[np.ndarray, list]:
        body = Body(texts)
        page, lang, sure = body.counted(least)
        keep = ~residue.is_residue(body.a)[page]
        page, lang, sure = page[keep], lang[keep], sure[keep]
        own = [re.split("[-_]", h or "", maxsplit=1)[0].strip().lower() for h in (hints.to_pylist() if hints is not None else [None] * len(texts))]
        alone = np.bincount(page, minlength=len(texts)) == 1
        names = [LANGUAGES[x] for x in lang.tolist()]
        right = [bool(alone[k]) and own[k] == x for k, x in zip(page.tolist(), names, strict=True)]
        order = np.lexsort((names, page)) if names else page
        return page[order], [[names[k] for k in order], sure[order].astype(float), [right[k] for k in order]]

    fields = [T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("hint_is_right", T.BooleanType())]
    return pages.mapped(df, id_col, text_col, fields, rows, hint_col)


def _stretches(body: Body) -> tuple[np.ndarray, list]:
    """The lines of each main body, or the sentences of lines in several languages, put together by language."""
    a = body.a
    spelled = list(linemodel.words().index)
    place = {c: k for k, c in enumerate(body.chosen.tolist())}
    first = np.searchsorted(body.seg.text, np.arange(len(body.chosen) + 1))
    of_line: dict[int, list[int]] = {}
    for k, line in enumerate(body.line.tolist()):
        of_line.setdefault(line, []).append(k)
    main = np.flatnonzero(~a.furniture & (a.code >= 0))
    texts = a.distinct.lines.take(pa.array(a.code[main])).to_pylist()
    rows: list[tuple[int, int, float, str]] = []  # page, language or -1, confidence, text
    for line, text in zip(main.tolist(), texts, strict=True):
        own = of_line.get(line, [])
        page = int(a.page[line])
        langs = {int(body.lang[k]) for k in own}
        if len(langs) < 2:
            rows.append((page, langs.pop() if langs else -1, float(np.mean(body.sure[own])) if own else -1.0, text))
            continue
        counted = iter(own)
        for s in range(first[place[int(a.code[line])]], first[place[int(a.code[line])] + 1]):
            words = " ".join(spelled[w] for w in body.seg.word[body.seg.start[s] : body.seg.start[s] + body.seg.n_words[s]].tolist())
            k = next(counted) if body.main[s] else None
            rows.append((page, -1 if k is None else int(body.lang[k]), -1.0 if k is None else float(body.sure[k]), words))
    # what tells no language goes with what stands before it on its page, else with what comes after
    langs = [r[1] for r in rows]
    for step in (range(1, len(rows)), range(len(rows) - 2, -1, -1)):
        d = -1 if step.step == 1 else 1
        for k in step:
            if langs[k] < 0 and rows[k + d][0] == rows[k][0]:
                langs[k] = langs[k + d]
    if any(x < 0 for x in langs):
        # pages without a sentence: by all the words of their body
        alone = [k for k, x in enumerate(langs) if x < 0]
        of_page: dict[int, list[str]] = {}
        for k in alone:
            of_page.setdefault(rows[k][0], []).append(rows[k][3])
        seg = linemodel.Segments.of(pa.array([" ".join(x) for x in of_page.values()], pa.string()))
        lang, sure = detected(seg)
        best = {list(of_page)[t]: (int(x), float(c)) for t, x, c in zip(seg.text.tolist(), lang.tolist(), sure.tolist(), strict=True)}
        for k in alone:
            langs[k], rows[k] = best[rows[k][0]][0], (rows[k][0], best[rows[k][0]][0], best[rows[k][0]][1], rows[k][3])
    out: list[list] = []
    for (page, _, sure, text), lang in zip(rows, langs, strict=True):
        if out and out[-1][0] == page and out[-1][1] == lang:
            out[-1][3].append(text)
        else:
            out.append([page, lang, [], [text], 1 + (out[-1][4] if out and out[-1][0] == page else 0)])
        if sure >= 0:
            out[-1][2].append(sure)
    names = ["und" if r[1] < 0 else LANGUAGES[r[1]] for r in out]
    sure = [float(np.mean(r[2])) if r[2] else 0.0 for r in out]
    return np.array([r[0] for r in out], np.int64), [[r[4] for r in out], names, sure, [len(r[2]) for r in out], ["\n".join(r[3]) for r in out]]


def segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, segment_no, lang, confidence, n_told, text) for each stretch of the main body in one language.

    All lines of the main body are in a segment; a line in several languages is parted by sentence. Headings, rows and the like,
    which tell no language, go with what stands beside them; n_told counts the lines and sentences that tell it, and confidence
    is their mean. A body without a sentence gets the language of all its words; one without letters is und, with 0.
    """
    fields = [T.StructField("segment_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_told", T.IntegerType()), T.StructField("text", T.StringType())]
    return pages.mapped(df, id_col, text_col, fields, lambda texts: _stretches(Body(texts)))


def sentences(text: str) -> list[str]:
    """The closed sentences of a text outside quotation marks, for fitting."""
    seg, closed, word = sentence_segments(pa.array([text], pa.string()))
    spelled = list(linemodel.words().index)
    return [" ".join(spelled[w] for w in word[a : a + n].tolist()) for a, n, ok in zip(seg.start, seg.n_words, closed, strict=True) if ok and n >= LEAST_WORDS]
