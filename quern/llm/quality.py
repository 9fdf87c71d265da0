"""Problem 10: statistics of a text and the verdict whether it is prose, list, table or junk.

Of each line, with its neighbours, the distributions of character classes, of word kinds, of function words
by language, of repeated words and of line shapes are held against profiles by Jensen-Shannon divergence; the nearest profile
gives the line's kind. The profiles, those of prose one or more for each language, are fitted on a labelled sample (train_quality.py); no
rule decides beside them. A text is what fills more than half of its non-white signs.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm import pages

MODELS = Path(__file__).parent / "models"
KINDS = ("prose", "list", "table", "junk")
#: Function words of the six languages.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in a is that for with on at by from as it its are was were be this which or an not no into than before after between since because while unless even so each who what every more".split()),
    "fr": frozenset("de la le les des et en un une que qui dans pour par sur avec au aux du ne pas plus est ce cette son sa se il elle on ou où dès sans entre pendant afin puisque bien si l d n".split()),
    "es": frozenset("el los las y del al con para por su sus lo una como más ya no sin entre hasta durante cada quien cuando aunque porque desde sobre".split()),
    "pt": frozenset("o os as e do da dos das em no na nos nas um uma com ao à aos às não mais pelo pela se quem cada já foi sem até durante enquanto porque embora onde seu sua".split()),
    "de": frozenset("der die das und ist mit den dem von zu im auf für in ein eine einen einer nicht auch wenn bei aus sich wer welche am zum zur vor nach wird wurde hat damit obwohl weil während je an als über".split()),
    "it": frozenset("di il i gli lo dei delle della del nel nella nelle negli al alla alle con per che chi non si ha è da dal dalla dai sulla sul su ogni tra più anche un una benché mentre perché poiché".split()),
}
_ALL_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values())
#: Parts of a line's distribution with their numbers of places and their weights.
PARTS = {"signs": (11, 2.0), "words": (6, 2.0), "languages": (7, 1.0), "repeats": (2, 0.7), "start": (8, 0.8), "end": (6, 0.8), "length": (6, 0.8), "width": (5, 0.6)}
SIZES = np.array([n for n, _ in PARTS.values()])
WEIGHTS = np.array([w for _, w in PARTS.values()]) / sum(w for _, w in PARTS.values())
STARTS = np.cumsum(SIZES) - SIZES
_VOWELS = frozenset("aeiouyàáâãäåèéêëìíîïòóôõöùúûüœæ")
#: Sign classes: 0 white, 1 vowel, 2 consonant, 3 capital, 4 digit, 5 sentence sign, 6 cell sign, 7 code sign, 8 other letter, 9 rest, 10 further white.
_CLASSES = np.full(65536, 9, np.uint8)
_LETTERS = np.zeros(65536, bool)
_END = r"[.!?…:;]['\"”’»)\]]*$"


def _fill() -> None:
    for c in range(65536):
        ch = chr(c)
        _LETTERS[c] = ch.isalpha()
        if ch in "|;":
            _CLASSES[c] = 6
        elif ch == "\t":
            _CLASSES[c] = 10
        elif ch.isspace() or 0x200B <= c <= 0x200D:
            _CLASSES[c] = 0
        elif ch.isdigit():
            _CLASSES[c] = 4
        elif ch in ".,!?…'’“”„«»¿¡():-–—\"‘":
            _CLASSES[c] = 5
        elif ch in "{}<>[]=\\^~%@$#&*_/+`":
            _CLASSES[c] = 7
        elif ch.isalpha():
            _CLASSES[c] = 3 if ch.isupper() else 1 if ch.lower() in _VOWELS else 2 if c < 0x250 else 8


_fill()
_TRIM = ".,:!?()\"'“”„«»‘’…¿¡-–—*•"
#: Signs that start the entries of lists.
_BULLETS = frozenset("- – — * • · ▪ ◦ ‣ ○ ● ► + » > [ [] [x] [X] [✓]".split())
_KINDS: dict[str, tuple[int, tuple[int, ...], int, int]] = {}


def _word(token: str) -> tuple[int, tuple[int, ...], int, int]:
    """(kind, languages it is a function word of, start class, end class) of a token between white space.

    Kinds: 0 function word, 1 other word, 2 capitalised, 3 number, 4 letters mixed with digits or signs or without a vowel, 5 signs.
    """
    known = _KINDS.get(token)
    if known is not None:
        return known
    bare = token.strip(_TRIM)
    low = bare.lower()
    own = tuple(k for k, words in enumerate(FUNCTION_WORDS.values()) if low in words)
    if own:
        kind = 0
    elif not bare or not any(c.isalnum() for c in bare):
        kind = 5
    elif all(c.isdigit() or c in ".,/:%€$£-" for c in bare):
        kind = 3
    elif all(c.isalpha() or c in "’'-" for c in bare):
        kind = 4 if len(bare) > 30 or not any(c in _VOWELS or ord(c) > 0x24F for c in low) else 2 if bare[0].isupper() else 1
    else:
        kind = 4
    first, last = token[0], token[-1]
    if token in _BULLETS:
        start = 4
    elif token[-1] in ").]" and 0 < len(bare) <= 3 and bare.isalnum() and len(token) <= 5:
        start = 7  # a number or letter that counts
    else:
        start = 0 if first.isupper() else 1 if first.islower() else 2 if first.isdigit() else 3 if first in "“„«\"‘¿¡(" else 5 if first in "|;" else 6
    tail = token.rstrip("\"'”’»)]")[-1:] or last
    end = 0 if tail in ".!?…" else 1 if tail in ",:" else 2 if tail.isalpha() else 3 if tail.isdigit() or tail == "%" else 4 if tail in "|;" else 5
    if len(_KINDS) > 300_000:
        _KINDS.clear()
    known = _KINDS[token] = (kind, own, start, end)
    return known


class Measured:
    """The lines of some texts as distributions, and the texts' statistics."""

    def __init__(self, texts: pa.Array) -> None:
        n = len(texts)
        lists = pc.split_pattern(texts, "\n")
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        lines = pc.utf8_rtrim_whitespace(lists.flatten())
        full = np.flatnonzero(np.asarray(pc.not_equal(pc.utf8_trim_whitespace(lines), "")))
        self.doc = np.repeat(np.arange(n), counts)[full]
        lines = lines.take(pa.array(full))
        n_lines = len(full)
        self.parts = {k: np.zeros((n_lines, size)) for k, (size, _) in PARTS.items()}
        # signs
        joined = "\n".join(lines.to_pylist())
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), 65535)
        classes = _CLASSES[codes].astype(np.int64)
        of = np.cumsum(codes == 10) - (codes == 10)
        lengths = np.asarray(pc.utf8_length(lines)).astype(np.int64)
        of = np.repeat(np.arange(n_lines), lengths + 1)[: len(codes)]
        white = (classes == 0) | (classes == 10)
        classes[1:][white[1:] & white[:-1]] = 10
        real = codes != 10
        table = np.bincount(of[real] * 11 + classes[real], minlength=n_lines * 11).reshape(n_lines, 11)
        self.parts["signs"][:] = table
        self.size = table[:, 1:10].sum(1)
        letters = _LETTERS[codes]
        begins = letters.copy()
        begins[1:] &= ~letters[:-1]
        words = np.bincount(self.doc[of[begins]], minlength=n) if len(of) else np.zeros(n, np.int64)
        n_letters = np.bincount(self.doc[of[letters]], minlength=n) if len(of) else np.zeros(n, np.int64)
        # words
        split = pc.utf8_split_whitespace(lines)
        line = np.repeat(np.arange(n_lines), np.asarray(pc.list_value_length(split)))
        coded = split.flatten().dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        keep = code != pc.index(coded.dictionary, "").as_py()
        line, code = line[keep], code[keep]
        looked = [_word(w) if w else (5, (), 6, 5) for w in coded.dictionary.to_pylist()]
        kind = np.array([x[0] for x in looked], np.int64)
        speech = np.zeros((len(looked), 7))
        for k, (_, own, _, _) in enumerate(looked):
            if own:
                speech[k, list(own)] = 1 / len(own)
            else:
                speech[k, 6] = 1
        np.add.at(self.parts["words"], (line, kind[code]), 1.0)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        if len(line):
            self.parts["languages"][line[first]] = np.add.reduceat(speech[code], first, axis=0)
            _, new = np.unique(self.doc[line] * len(looked) + code, return_index=True)
            again = np.ones(len(line), np.int64)
            again[new] = 0
            np.add.at(self.parts["repeats"], (line, again), 1.0)
            last = np.append(first[1:], len(line)) - 1
            self.parts["start"][line[first], np.array([x[2] for x in looked])[code[first]]] = 1
            self.parts["end"][line[first], np.array([x[3] for x in looked])[code[last]]] = 1
            n_words = np.bincount(line, minlength=n_lines)
            self.parts["length"][np.arange(n_lines), np.searchsorted([2, 5, 8, 13, 26], n_words, "right")] = 1
            self.parts["width"][np.arange(n_lines), np.searchsorted([6, 9, 14, 40], table[:, :10].sum(1) / np.maximum(n_words, 1), "right")] = 1
        # statistics of the texts
        solid = np.bincount(self.doc, self.size, n)
        digits = np.bincount(self.doc, table[:, 4], n)
        ends = np.asarray(pc.match_substring_regex(lines, _END)).astype(float)
        plain = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
        of_text = np.repeat(np.arange(n), np.asarray(pc.list_value_length(plain)))
        spelled = plain.flatten().dictionary_encode()
        common = np.array([w in _ALL_FUNCTION_WORDS for w in spelled.dictionary.to_pylist()], bool)
        n_common = np.bincount(of_text[common[np.asarray(spelled.indices)]], minlength=n) if len(of_text) else np.zeros(n)
        over = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        self.solid = solid
        self.statistics = [words.astype(np.int32), over(n_letters, words), over(solid - n_letters - digits, solid), over(np.bincount(self.doc, ends, n), np.bincount(self.doc, minlength=n)), over(n_common, words)]

    def distributions(self) -> np.ndarray:
        """A row for each line: the parts one after the other, each with its weight as its sum, neighbours included."""
        out = np.zeros((len(self.doc), int(SIZES.sum())), np.float32)
        full = np.maximum(self.size, 1)
        same = (self.doc[1:] == self.doc[:-1]).astype(float)
        # a neighbour counts as much as the line, and less where it is shorter
        before, after = same * np.minimum(1, full[:-1] / full[1:]), same * np.minimum(1, full[1:] / full[:-1])
        for part, at, weight, size in zip(self.parts.values(), STARTS, WEIGHTS, SIZES, strict=True):
            own = part / np.maximum(part.sum(1, keepdims=True), 1e-9)
            near = own.copy()
            near[1:] += before[:, None] * own[:-1]
            near[:-1] += after[:, None] * own[1:]
            out[:, at : at + size] = weight * near / np.maximum(near.sum(1, keepdims=True), 1e-9)
        return out

    def verdicts(self, kinds: np.ndarray) -> list[str | None]:
        """The kind of each text from its lines' places in KINDS; null for a text without signs."""
        n = len(self.solid)
        weight = np.bincount(self.doc * len(KINDS) + kinds, self.size, n * len(KINDS)).reshape(n, len(KINDS)) if len(self.doc) else np.zeros((n, len(KINDS)))
        other = 1 + weight[:, 1:].argmax(1)
        prose = 2 * weight[:, 0] >= self.solid
        return [None if not s else KINDS[0] if p else KINDS[o] for s, p, o in zip(self.solid, prose, other, strict=True)]


def _plogp(p: np.ndarray) -> np.ndarray:
    return p * np.log2(np.maximum(p, np.float32(1e-12)))


def divergence(rows: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon divergence of each row from each profile."""
    own, theirs = _plogp(rows).sum(1), _plogp(profiles).sum(1)
    out = np.empty((len(rows), len(profiles)), np.float32)
    for k in range(len(profiles)):
        out[:, k] = (own + theirs[k]) / 2 - _plogp((rows + profiles[k]) / 2).sum(1)
    return out


@lru_cache(maxsize=1)
def profiles() -> tuple[np.ndarray, np.ndarray]:
    """(profiles, the place in KINDS of each)."""
    with np.load(MODELS / "profiles.npz") as data:
        return data["profiles"].astype(np.float32), data["kinds"].astype(np.int64)


def nearest(rows: np.ndarray) -> np.ndarray:
    """The place in KINDS of the profile nearest to each row."""
    table, kinds = profiles()
    return kinds[divergence(rows, table).argmin(1)] if len(rows) else np.zeros(0, np.int64)


def assess(texts: pa.Array) -> list:
    """The columns of statistics for an array of texts."""
    m = Measured(texts)
    return [*[pa.array(c) for c in m.statistics], pa.array(m.verdicts(nearest(m.distributions())), pa.string())]


_FIELDS = [T.StructField("word_count", T.IntegerType()), T.StructField("mean_word_length", T.DoubleType()), T.StructField("symbol_ratio", T.DoubleType()), T.StructField("ending_ratio", T.DoubleType()), T.StructField("common_ratio", T.DoubleType()), T.StructField("kind", T.StringType())]


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, word_count, mean_word_length, symbol_ratio, ending_ratio, common_ratio, kind) of the non-null texts of df.

    Ratios are of non-white signs that are neither letter nor digit, of non-blank lines that end in punctuation, and of words
    that are function words; they are 0 for empty and blank texts, whose kind is null. kind is prose unless more than half of
    the non-white signs are something else; then it is the kind that fills most. Null texts give no row.
    """

    return pages.mapped(df, id_col, text_col, _FIELDS, lambda texts: (np.arange(len(texts)), assess(texts)))


def not_prose(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, kind) of the texts that are mostly list, table or junk."""
    return statistics(df, id_col, text_col).where("kind <> 'prose'").select(id_col, "kind")
