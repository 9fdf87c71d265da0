"""Problem 6: text from a wrong character encoding, found and restored by minimum description length.

Every chain of wrong decodings is undone on a suspect line, and each candidate is compressed with a zstandard dictionary for
each language. The candidate with the shortest description, its chain included, wins; otherwise the line stays as it is.
Suspect are lines with a non-ASCII word that the dictionaries' texts don't hold.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import spread

MODELS = Path(__file__).parent / "models"
LANGUAGES = ("en", "pt", "es", "fr", "de", "it")
#: Wrong decodings (read as, written as) that are undone, one step each.
STEPS = (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("gbk", "utf-8"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"))
#: Chains of two steps start with one of these.
TWICE = (("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"))
#: Bytes a chain costs: its first step to another single-byte encoding or to UTF-8, whose bytes are seldom valid by chance, and each further step.
CHAIN_COST, UTF8_COST, STEP_COST = 2, 0, 1
#: Compression levels: of all descriptions, and of those of UTF-8, which is seldom valid by chance; the lower misses matches at a text's start.
LEVEL, FINE = 3, 12
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"“[^“”„«»]+[”“]|„[^“”„«»]+[“”]|«[^“”«»]+»|\"[^\"]+\"")
LOST = "�"


def _unusual(e: UnicodeEncodeError) -> tuple[str, int]:
    """Signs outside cp1252 stand as question marks: two for one of the basic plane, one for emoji and the like."""
    return "".join("?" if ord(c) > 0xFFFF else "??" for c in e.object[e.start : e.end]), e.end


def _controls(e: UnicodeEncodeError) -> tuple[bytes, int]:
    """Bytes that a code page leaves open are read as control signs."""
    part = e.object[e.start : e.end]
    if any(not 0x80 <= ord(c) <= 0x9F for c in part):
        raise e
    return part.encode("latin-1"), e.end


codecs.register_error("quern-unusual", _unusual)
codecs.register_error("quern-controls", _controls)
#: Signs that a word may hold beside its letters: marks of Latin text, General Punctuation, currency, arrows, shapes, emoji and
#: joiners. Box drawing, mathematics and the other signs of Latin-1 stand inside a word only where it is garbled.
_USUAL = re.compile(r"[\xa0¡«»¿·©®°º§×€£ªµ\u200b-\u205e\ufeff\ufe0f\u20a0-\u20bf\u2116\u2190-\u21ff\u25a0-\u27bf\U0001f000-\U0001faff\u0300-\u036f]")
_PIECES = re.compile(r"[^\W\d_]+|[^\x00-\x7f\w]")
_GAPPED = re.compile(f"[^\\W\\d_]*{LOST}[^\\W\\d_{LOST}]*(?:{LOST}[^\\W\\d_{LOST}]*)*")
_PARTS = re.compile(r"(?<=[.!?…]) (?=\S)")


def _undo(text: str, read_as: str, written_as: str) -> str | None:
    """text as it was before bytes written in one encoding were read in another; None if it can't have come that way."""
    try:
        data = text.encode(read_as, "quern-controls" if written_as == "utf-8" and read_as in ("cp1252", "cp1250", "cp1251") else "strict")
    except UnicodeEncodeError:
        return None
    try:
        return data.decode(written_as)
    except UnicodeDecodeError:
        return None


def _undo_parts(text: str, step: tuple[str, str]) -> str | None:
    """As _undo; where characters are lost, each part beside them is restored, and what is broken there stays lost."""
    if LOST not in text:
        return _undo(text, *step)
    out = []
    for k, part in enumerate(text.split(LOST)):
        fixed = _undo(part, *step)
        # a sequence cut by the loss has its first or last signs left over
        for trim in (1, 2):
            if fixed is None and k + 1 <= text.count(LOST) and len(part) > trim:
                fixed = _undo(part[:-trim], *step)
        if fixed is None:
            return None
        out.append(fixed)
    return LOST.join(out)


class Repairer:
    def __init__(self, folder: Path = MODELS) -> None:
        import zstandard

        labelled = "\n".join(x for x in (folder / "lines.txt").read_text(encoding="utf-8").split("\n") if x[:1] not in "#D")
        self.coders, self.fine, self.known = [], [], set()
        for language in LANGUAGES:
            prose = (folder / f"prose_{language}.txt").read_text(encoding="utf-8")
            data = (labelled + prose).encode("cp1252", "quern-unusual")
            for level, coders in ((LEVEL, self.coders), (FINE, self.fine)):
                params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
                own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=params)
                coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))
            self.known.update(w for text in (labelled, prose) for w in _LETTERS.findall(text.lower()) if not w.isascii())
        self.known.update((folder / "words.txt").read_text(encoding="utf-8").split())
        self.known -= {w for w in self.known if len(w) == 1 and w not in "àáéèêíìóòúùoaõ"}
        gaps: dict[str, set[str]] = {}
        for w in self.known:
            gaps.setdefault(re.sub(r"[^\x00-\x7f]", LOST, w), set()).add(w)
        self.gaps = {g: min(ws) for g, ws in gaps.items() if len(ws) == 1 and len(g) > 1}
        self.tokens: dict[str, bool] = {}
        self.lines: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {}

    def strange(self, token: str) -> bool:
        """Whether a token has a non-ASCII word that is in no dictionary, or a sign that doesn't go with its letters."""
        known = self.tokens.get(token)
        if known is None:
            lower = _USUAL.sub(" ", token.lower())
            lettered = any(c.isalpha() for c in token)
            known = any(not w.isascii() and (w not in self.known if w[0].isalpha() else lettered or w == LOST or w < "\xa0") for w in _PIECES.findall(lower))
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            self.tokens[token] = known
        return known

    def unknown(self, text: str) -> int:
        """How many of the text's words are strange."""
        return sum(self.strange(t) for t in text.split() if not t.isascii())

    def suspect(self, text: str) -> bool:
        return any(self.strange(t) for t in text.split() if not t.isascii())

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """Which of the texts hold a strange word; each distinct word is looked at once."""
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        plain = np.asarray(pc.string_is_ascii(coded.dictionary))
        marked = np.zeros(len(plain), bool)
        at = np.flatnonzero(~plain)
        marked[at] = [self.strange(w) for w in coded.dictionary.take(pa.array(at)).to_pylist()]
        of = np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        return np.bincount(of[marked[np.asarray(coded.indices)]], minlength=len(texts)) > 0

    def restored(self, texts: pa.Array) -> pa.Array:
        """The texts as repair gives them; only those with a strange word are touched."""
        at = np.flatnonzero(self.suspects(texts))
        if not len(at):
            return texts
        out = texts.to_pylist()
        for k in at.tolist():
            out[k] = self.repair(out[k])[0]
        return pa.array(out, pa.string())

    def length(self, text: str, fine: bool = False) -> int:
        data = text.encode("cp1252", "quern-unusual")  # one byte a sign, so that no sign is dear for its encoding alone
        return min(len(c.compress(data)) for c in (*self.coders, *(self.fine if fine else ()))) + 4 * text.count(LOST)

    def best(self, line: str) -> tuple[str, tuple[tuple[str, str], ...]]:
        """(restored line, chain); the chain is empty if the line stays."""
        known = self.lines.get(line)
        if known is not None:
            return known
        words = line.split(" ")
        marked = [not w.isascii() for w in words]
        # what is described: the non-ASCII words with their neighbours
        short = " ".join(w for k, w in enumerate(words) if any(marked[max(0, k - 1) : k + 2]))
        best, least = (), self.length(short)
        seen = {short}
        for first in STEPS:
            once = _undo_parts(short, first)
            if once is None or once in seen:
                continue
            seen.add(once)
            chains = [((first,), once)]
            if first in TWICE and not once.isascii():
                for second in TWICE:
                    twice = _undo_parts(once, second)
                    if twice is not None and twice not in seen:
                        seen.add(twice)
                        chains.append(((first, second), twice))
            for chain, text in chains:
                if any(0x80 <= ord(c) <= 0x9F for c in text):
                    continue
                cost = self.length(text, chain[-1][1] == "utf-8") + (UTF8_COST if first[1] == "utf-8" else CHAIN_COST) + STEP_COST * (len(chain) - 1)
                # a single-byte reading, and one whose description is no shorter, must also leave fewer strange words
                if cost < least and chain[-1][1] == "utf-8" or (cost < least or cost == least and not best) and self.unknown(text) < self.unknown(short):
                    best, least = chain, cost
        fixed = line
        for step in best:
            fixed = None if fixed is None else _undo_parts(fixed, step)
        result = (line, ()) if fixed is None else (fixed, best)
        if len(self.lines) > 50_000:
            self.lines.clear()
        self.lines[line] = result
        return result

    def _filled(self, line: str) -> str:
        """line with lost letters put back where one known word alone fits."""

        def fill(m: re.Match) -> str:
            word = m.group()
            full = self.gaps.get(word.lower())
            return word if full is None else full.upper() if word.replace(LOST, "").isupper() and len(word) > 2 else full.capitalize() if word[0].isupper() else full

        return _GAPPED.sub(fill, line)

    def repair(self, text: str) -> tuple[str, int, int]:
        """(restored text, lines changed, characters lost for good); quoted words alone don't make a line garbled.

        A chain is paid for once a page: it is tried without cost on the page's other suspect lines.
        """
        if text.isascii() or not self.suspect(text):
            return text, 0, 0
        out = text.split("\n")
        chains: Counter = Counter()
        left, changed, lost = [], 0, 0
        for k, line in enumerate(out):
            if line.isascii() or not self.suspect(line):
                continue
            bare = _QUOTED.sub('""', line)
            if bare != line and not self.suspect(bare):
                continue
            out[k], own = self._by_parts(bare, line)
            lost += bare.count(LOST)
            if own:
                changed += 1
                chains.update(own)
            else:
                left.append(k)
        for k in left:
            for chain, _ in chains.most_common():
                fixed = out[k]
                for step in chain:
                    fixed = None if fixed is None else _undo_parts(fixed, step)
                if fixed is not None and fixed != out[k] and (self.length(fixed) <= self.length(out[k]) or self.unknown(fixed) < self.unknown(out[k])):
                    out[k] = fixed
                    changed += 1
                    break
        if lost:
            out = [self._filled(x) if LOST in x else x for x in out]
        return "\n".join(out), changed, lost

    def _by_parts(self, bare: str, line: str) -> tuple[str, list[tuple[tuple[str, str], ...]]]:
        """The line restored as a whole, else its sentences one by one, as only some may be garbled; with the chains."""
        fixed, chain = self.best(line)
        if chain:
            return fixed, [chain]
        parts = _PARTS.split(line)
        if len(parts) == 1:
            return line, []
        done = [self.best(p) if not p.isascii() and self.suspect(_QUOTED.sub('""', p)) else (p, ()) for p in parts]
        return " ".join(p for p, _ in done), [c for _, c in done if c]


@lru_cache(maxsize=1)
def repairer() -> Repairer:
    return Repairer()


def repaired(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, changed_lines, lost) for each row of df: the text as first written wherever it can be had.

    changed_lines counts restored lines and lost the signs that are gone for good (U+FFFD outside short quotations); both are
    0 for a clean text. A page that only quotes a garbled word stays. Null stays null, with 0 and 0.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("changed_lines", T.IntegerType()), T.StructField("lost", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = repairer()
        for batch in batches:
            text, changed, lost = batch.column(1).to_pylist(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for k in np.flatnonzero(own.suspects(batch.column(1))).tolist():
                text[k], changed[k], lost[k] = own.repair(text[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(changed), pa.array(lost)], schema.names)

    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids of rows with any part of the text garbled, restorable or not; pure ASCII texts are left out in the scan."""
    rows = df.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) > F.length(text_col)))
    return repaired(rows, id_col, text_col).where("changed_lines + lost > 0").select(id_col)
