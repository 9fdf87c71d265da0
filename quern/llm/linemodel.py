"""A linear classifier of lines: furniture, box title, heading, byline, message or content.

Its features are the folded words and word pairs of a line, signs that stand for tags, and its shape. The weights come from
the labelled lines in models/lines.txt and from prose (train.py). Batches of texts are read as arrays: each distinct word is
looked at once per process, and one pass of sums gives the scores of all lines, parts of lines or sentences.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MODELS = Path(__file__).parent / "models"
CLASSES = "FBTPMC"
SIGNS = "|·>»©*@#{}%<=[]~$_/•–;.!?…"
#: Signs that a line may start with whatever it is.
LEADING = "*•>»#[]!"
_TOKEN = re.compile(r"[a-z]+|[0-9]+|[|·>»©*@#{}%<=\[\]~$_/•–;]|[.!?…]")
_UNMARKED = dict.fromkeys(range(0x300, 0x370))
#: Spellings of slots that no template engine filled.
SLOT = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|<<[\w.]+>>|\$\{[\w.]+\}|#\{[\w.]+\}|##[\w.]+##|@@[\w.]+@@|\[\[[\w.]+\]\]|__[A-Za-z][\w.]*?__|~[a-z][\w.]*~|%[a-z][a-z_.]*%"
    r"|\bINSERT [\w.]+ HERE\b|(?<!\w)\[(?:[a-z]+[_.][a-z_.]+|title|body|address|author|summary|name|text|content)\]|\{[a-z][a-z_.]*\}|<(?:[a-z]+[_.][a-z_.]+|title|body|address|author|summary)>",
    re.I,
)
#: What every slot holds.
SLOT_SIGN = re.compile(r"[{<$#@\[_~%]|insert", re.I)
SLOT_MARK = "\x00"
#: Distinct words a process keeps; at the bound it starts afresh between batches, which changes speed alone.
STORED = 400_000
#: Flags of a word: what it ends or starts.
END, CLOSE, SHORT, START, CLOSED, SYMBOL, MARKED = 1, 2, 4, 8, 16, 32, 64
_FLAGS = (
    (END, re.compile(r"[.!?…]$")),
    (CLOSE, re.compile(r"[.!?…][\"”»“)\]]*$")),
    # fixed values: words before a full stop that ends no sentence
    (SHORT, re.compile(r"(?:(?<!\w)(?:inkl|incl|ca|nr|no|aprox|approx|est|ex|ej|es|[a-zA-Z]))\.[\"”»“)\]]*$", re.I)),
    (START, re.compile(r"[^\Wa-zß-öø-ÿ\d_]|[“«„\"¿¡(]")),
    (CLOSED, re.compile(r"[.!?…]\W*$")),
)
_LETTER = re.compile(r"\w")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_UNMARKED).replace("ß", "ss").replace("œ", "oe")


def tokens(line: str, vocabulary: frozenset[str]) -> list[str]:
    """The folded words, signs, numbers ("0") and unknown words ("N") of a line, without the signs before its first word."""
    out = [t if t in vocabulary or not t[0].isalnum() else "0" if t[0].isdigit() else "N" for t in _TOKEN.findall(fold(line))]
    k = 0
    while k < len(out) and out[k] in LEADING:
        k += 1
    return out[k:]


def width(words: int) -> str:
    return f"w{min(words, 6)}" if words < 7 else "w7" if words < 12 else "w12" if words < 25 else "w25"


def features(toks: list[str]) -> list[str]:
    words = sum(t.isalpha() for t in toks)
    shape = ["bias", width(words), f"end{toks[-1] if toks and not toks[-1].isalnum() else ''}", f"start{toks[0] if toks and not toks[0].isalnum() else ''}"]
    return [*shape, *toks, *[f"{a} {b}" for a, b in zip(["^", *toks], [*toks, "$"], strict=True)]] if toks else shape


class LineModel:
    """Weights by token number: 0 is a slot, then N, 0, the signs and the vocabulary."""

    def __init__(self, path: Path = MODELS / "lines.npz") -> None:
        with np.load(path) as data:
            words, names, weights = data["vocabulary"].tolist(), data["features"].tolist(), data["weights"].astype(np.float32)
        self.vocabulary = frozenset(words)
        self.names = [SLOT_MARK, "N", "0", *SIGNS, *sorted(self.vocabulary - {"N", "0"})]
        self.number = {t: k for k, t in enumerate(self.names)}
        n = len(self.names)
        self.alpha = np.array([t.isalpha() for t in self.names])
        self.leading = np.array([t in LEADING for t in self.names])
        row = {f: k for k, f in enumerate(names)}
        pick = lambda keys: np.stack([weights[row[k]] if k in row else np.zeros(len(CLASSES), np.float32) for k in keys])
        edge = lambda side: pick([side + (t if not t.isalnum() else "") for t in self.names])
        self.single, self.last, self.first = pick(self.names), edge("end"), edge("start")
        self.bare = pick(["bias", width(0), "end", "start"]).sum(0)
        self.wide = pick([width(k) for k in range(26)]) + pick(["bias"])
        pairs = [(f.split(" "), k) for f, k in row.items() if " " in f]
        code = {**self.number, "^": n, "$": n + 1}
        self.base = n + 2
        keys = np.array([code[a] * self.base + code[b] for (a, b), _ in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_weights = weights[[k for _, k in pairs]][order]
        self.seen = np.zeros(1 << 21, bool)
        self.seen[self._slot(self.pair_keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def probabilities(self, toks: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A row of CLASSES for each segment; toks lie in segment order, segment k begins at starts[k] and none is empty."""
        if not len(starts):
            return np.zeros((0, len(CLASSES)), np.float32)
        stops = np.append(starts[1:], len(toks))
        before = np.concatenate([[0], toks[:-1]]).astype(np.int64)
        before[starts] = self.base - 2
        keys = before * self.base + toks
        ends = toks[stops - 1].astype(np.int64) * self.base + self.base - 1
        z = np.add.reduceat(self.single[toks], starts, axis=0) + self.wide[np.minimum(words, 25)] + self.first[toks[starts]] + self.last[toks[stops - 1]]
        for own, of in ((keys, np.repeat(np.arange(len(starts)), stops - starts)), (ends, np.arange(len(starts)))):
            hit = np.flatnonzero(self.seen[self._slot(own)])
            at = np.searchsorted(self.pair_keys, own[hit])
            at[at == len(self.pair_keys)] = 0
            right = self.pair_keys[at] == own[hit]
            hit, at = hit[right], at[right]
            if len(hit):
                rows = of[hit]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                z[rows[first]] += np.add.reduceat(self.pair_weights[at], first, axis=0)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def of_line(self, line: str) -> np.ndarray:
        """One probability for each of CLASSES."""
        return Segments.of(pa.array([line])).p[0]


@lru_cache(maxsize=1)
def model() -> LineModel:
    return LineModel()


class Words:
    """What is known of each distinct word: its token numbers and flags."""

    def __init__(self) -> None:
        self.model = model()
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.toks: list[int] = []
        self.stops: list[int] = [0]
        self.flags: list[int] = []
        self._arrays: tuple[np.ndarray, ...] | None = None

    def look(self, words: list[str]) -> np.ndarray:
        if len(self.index) > STORED:
            self.clear()
        index = self.index
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = index.get(w)
            if n is None:
                n = self._add(w)
            out[k] = n
        return out

    def _add(self, word: str) -> int:
        number = self.model.number
        n = self.index[word] = len(self.index)
        self._arrays = None
        if word.isascii() and word.isalnum():
            # plain words are most of all: one token or several, and no sign
            for t in [word.lower()] if word.isalpha() else _TOKEN.findall(word.lower()):
                self.toks.append(number[t] if t in number else number["0"] if t[0].isdigit() else number["N"])
            self.stops.append(len(self.toks))
            self.flags.append(START if word[0].isupper() else 0)
            return n
        if word == SLOT_MARK:
            self.toks.append(0)
        else:
            for t in _TOKEN.findall(fold(word)):
                self.toks.append(number[t] if t in number else number["0"] if t[0].isdigit() else number["N"])
        self.stops.append(len(self.toks))
        flags = 0
        for bit, pattern in _FLAGS:
            if pattern.match(word) if bit == START else pattern.search(word):
                flags |= bit
        if not _LETTER.search(word):
            flags |= SYMBOL
        if not word.isascii():
            flags |= MARKED
        self.flags.append(flags)
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._arrays is None:
            self._arrays = np.array(self.toks, np.int32), np.array(self.stops, np.int64), np.array(self.flags, np.int64)
        return self._arrays


@lru_cache(maxsize=1)
def words() -> Words:
    return Words()


@dataclass
class Segments:
    """Segments of texts (whole texts, parts or sentences) with their tokens; segments lie in text order."""

    text: np.ndarray  # of each segment, the text it is of
    start: np.ndarray  # of each segment, its first word
    n_words: np.ndarray
    word: np.ndarray  # all words by their numbers
    tok: np.ndarray = field(repr=False)
    of: np.ndarray = field(repr=False)  # of each token, its segment

    @classmethod
    def of_words(cls, text: np.ndarray, word: np.ndarray, begins: np.ndarray) -> Segments:
        """text and word of each word; begins marks the words that open a segment beside those that open a text."""
        table = words()
        toks, stops, _ = table.arrays()
        new = begins.copy()
        if len(text):
            new[0] = True
            new[1:] |= text[1:] != text[:-1]
        start = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        n = stops[word + 1] - stops[word]
        at = np.repeat(stops[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        tok, of = toks[at].astype(np.int64), np.repeat(segment, n)
        # signs before the first word of a segment are left out
        lead = table.model.leading[tok]
        if lead.any() and len(tok):
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            first = np.minimum.reduceat(np.where(lead, len(tok), np.arange(len(tok))), heads)
            keep = np.arange(len(tok)) >= np.repeat(first, np.diff(np.append(heads, len(tok))))
            tok, of = tok[keep], of[keep]
        return cls(text[start], start, np.diff(np.append(start, len(word))), word, tok, of)

    @classmethod
    def of(cls, texts: pa.Array) -> Segments:
        """Each text with a word as one segment."""
        text, word = split_words(texts)
        return cls.of_words(text, word, np.zeros(len(word), bool))

    def __len__(self) -> int:
        return len(self.start)

    def count(self, which: np.ndarray) -> np.ndarray:
        """How many tokens of each segment are marked."""
        return np.bincount(self.of[which], minlength=len(self)) if len(self) else np.zeros(0, np.int64)

    @cached_property
    def alpha(self) -> np.ndarray:
        return self.count(model().alpha[self.tok])

    @cached_property
    def unknown(self) -> np.ndarray:
        return self.count(self.tok == model().number["N"])

    @cached_property
    def slots(self) -> np.ndarray:
        return self.count(self.tok == 0)

    @cached_property
    def size(self) -> np.ndarray:
        return self.count(self.tok > 0)

    @cached_property
    def p(self) -> np.ndarray:
        """Probabilities by CLASSES; those of no words at all for segments without tokens."""
        plain = self.tok > 0
        tok, of = self.tok[plain], self.of[plain]
        out = np.zeros((len(self), len(CLASSES)), np.float32)
        z = np.exp(model().bare)
        out[:] = z / z.sum()
        if len(tok):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[starts]] = model().probabilities(tok, starts, self.alpha[of[starts]])
        return out

    def masked(self, which: np.ndarray) -> list[str]:
        """The tokens of some segments, each as one text."""
        names = model().names
        bounds = np.searchsorted(self.of, np.arange(len(self) + 1))
        return [" ".join(["slotslot" if t == 0 else names[t] for t in self.tok[bounds[k] : bounds[k + 1]].tolist()]) for k in which.tolist()]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of each word of the texts; null texts have none."""
    lists = pc.utf8_split_whitespace(texts)
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    numbers = words().look(coded.dictionary.to_pylist())
    codes = np.asarray(coded.indices).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        text, codes = text[keep], codes[keep]
    return text, numbers[codes]


def flags_of(word: np.ndarray) -> np.ndarray:
    return words().arrays()[2][word]


def parts(texts: pa.Array) -> Segments:
    """The parts of texts: what ends with a sentence sign at the end of a word."""
    text, word = split_words(texts)
    ends = (flags_of(word) & END) > 0
    begins = np.zeros(len(word), bool)
    begins[1:] = ends[:-1]
    return Segments.of_words(text, word, begins)
