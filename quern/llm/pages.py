"""Problem 4: the main body of a page, by maximum-scoring subsequences over its lines.

The words of a line and the signs that stand for tags add up to its score: positive for main text, negative for menus, notices
and other furniture, with the weights of the line classifier; each line break costs a little, as a tag does. A linear scan
finds the maximal regions of positive sum. A region counts if its sum shows text of its own, so a weak line outside of one is
furniture and a weak line inside one is main text; inside a region, the same scan with the signs turned cuts out boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import linemodel, mojibake
from quern.session import spread

#: A line's score has these bounds; what a line break costs; the least sum of a region that counts, and of a box inside one.
BOUND, BREAK, REGION, BOX = 4.0, 0.2, 1.0, 0.7
#: How sure the best sentence of a line must be to make the line main text, and the words it must have.
SURE, LEAST_WORDS = 0.6, 4
#: Signs of text that are analysed at once; it changes speed and memory alone.
CHUNK = 2_000_000
_F, _B, _T, _P, _M, _C = range(6)


def regions(scores: list[float]) -> list[tuple[int, int]]:
    """The maximal scoring subsequences (start, stop), in order, by the linear scan of Ruzzo and Tompa."""
    return [(a, b) for a, b, _ in _regions(scores)]


def _regions(scores: list[float]) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float, float]] = []  # start, stop, sum before it, sum through it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = (out[j][0], new[1], out[j][2], new[3])
            del out[j:]
    return [(a, b, through - before) for a, b, before, through in out]


def main_lines(scores: list[float]) -> list[bool]:
    """Which lines of a page lie in a region that counts and in no box inside it."""
    inside = [False] * len(scores)
    for a, b, total in _regions(scores):
        if total < REGION:
            continue
        inside[a:b] = [True] * (b - a)
        own = scores[a:b]
        if min(own) < 0:
            for c, d, weight in _regions([-s for s in own]):
                if weight >= BOX:
                    for i in range(a + c, a + d):
                        inside[i] = scores[i] > 0
    return inside


class Lines:
    """Distinct lines: their class, their score and their parts."""

    def __init__(self, lines: pa.Array) -> None:
        self.lines = lines
        hits = np.flatnonzero(np.asarray(pc.match_substring_regex(lines, linemodel.SLOT_SIGN.pattern, ignore_case=True)))
        self.slotted = np.zeros(len(lines), bool)
        if len(hits):
            texts = lines.to_pylist()
            for k in hits.tolist():
                plain = linemodel.SLOT.sub(f" {linemodel.SLOT_MARK} ", texts[k])
                if plain != texts[k]:
                    self.slotted[k] = True
                    texts[k] = plain
            lines = pa.array(texts, pa.string())
        self.plain = lines
        self.parts = linemodel.parts(lines)
        self.kind, self.score = self._classes()

    def _classes(self) -> tuple[np.ndarray, np.ndarray]:
        n, parts = len(self.lines), self.parts
        p = np.zeros((n, 6), np.float32)
        p[:] = parts.p[0] if len(parts) else 1 / 6
        size, alpha, unknown = (np.zeros(n, np.int64) for _ in range(3))
        for out, of in ((size, parts.size), (alpha, parts.alpha), (unknown, parts.unknown)):
            np.add.at(out, parts.text, of)
        n_parts = np.bincount(parts.text, minlength=n)
        single = n_parts[parts.text] == 1
        p[parts.text[single]] = parts.p[single]
        several = n_parts > 1
        if several.any():
            # of these the whole line is classified too
            rows = np.repeat(parts.text, parts.n_words)
            chosen = several[rows]
            whole = linemodel.Segments.of_words(rows[chosen], parts.word[chosen], np.zeros(int(chosen.sum()), bool))
            p[whole.text] = whole.p
        kind = p.argmax(1)
        score = np.clip(np.log((p[:, [_T, _P, _M, _C]].sum(1) + 1e-3) / (p[:, [_F, _B]].sum(1) + 1e-3)), -BOUND, BOUND)
        sure = several[parts.text] & (parts.alpha >= LEAST_WORDS) & (parts.p[:, _C] > SURE)
        # a line with unresolved slots is residue unless a sentence of its own stands beside or around them
        sure |= self.slotted[parts.text] & (parts.alpha > LEAST_WORDS + 1) & (parts.p[:, _C] > 0.5)
        text = np.zeros(n, bool)
        text[parts.text[sure]] = True
        kind[text], score[text] = _C, BOUND
        bare = size == 0
        kind[bare], score[bare] = _C, 0.1
        named = (alpha > 0) & (alpha <= 3) & (size <= 4) & (alpha == unknown)
        kind[named], score[named] = _T, 0.5
        slots = self.slotted & ~text
        kind[slots], score[slots] = _M, BOUND
        return kind, score


@dataclass
class Analysis:
    """The lines of some pages in order. Blank lines have kind -1 and are never furniture."""

    page: np.ndarray
    code: np.ndarray  # of each line, its place among the distinct lines; -1 for blank ones
    distinct: Lines
    counts: np.ndarray  # lines of each page

    @classmethod
    def of(cls, texts: pa.Array) -> Analysis:
        lists = pc.split_pattern(texts, "\n")
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.utf8_trim_whitespace(lists.flatten()).dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        blank = pc.index(coded.dictionary, "").as_py()
        distinct = Lines(coded.dictionary)
        return cls(np.repeat(np.arange(len(counts)), counts), np.where(code == blank, -1, code), distinct, counts)

    @cached_property
    def kind(self) -> np.ndarray:
        return np.where(self.code < 0, -1, self.distinct.kind[self.code])

    @cached_property
    def boxed(self) -> np.ndarray:
        """Headings right after the title of a link box: its links."""
        kind, at = self.kind, np.arange(len(self.kind))
        before = np.maximum.accumulate(np.where(kind != _T, at, -1)) if len(at) else at
        return (kind == _T) & (before >= 0) & (self.page[before] == self.page) & (kind[before] == _B)

    @cached_property
    def furniture(self) -> np.ndarray:
        full = np.flatnonzero(self.code >= 0)
        scores = np.where(self.boxed[full], -BOUND, self.distinct.score[self.code[full]] - BREAK)
        bounds = np.searchsorted(self.page[full], np.arange(len(self.counts) + 1)).tolist()
        scores = scores.tolist()
        inside: list[bool] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            inside += main_lines(scores[a:b])
        out = np.zeros(len(self.code), bool)
        out[full] = ~np.array(inside, bool)
        return out

    @cached_property
    def number(self) -> np.ndarray:
        """The number of each line in its page, from 1."""
        return np.arange(len(self.page)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts) + 1


def restored(texts: pa.Array) -> pa.Array:
    """The texts as first written, as far as mojibake can tell."""
    return mojibake.repairer().restored(texts)


def page_lines(text: str) -> tuple[list[str], list[int], list[bool]]:
    """(lines as restored, class of each, whether it is furniture) of one page."""
    texts = restored(pa.array([text], pa.string()))
    a = Analysis.of(texts)
    return [x.strip() for x in texts[0].as_py().split("\n")], a.kind.tolist(), a.furniture.tolist()


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of CHUNK signs of text, or of one row."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def mapped(df: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], rows: Callable[..., tuple[np.ndarray, list]], extra: str | None = None) -> DataFrame:
    """Rows of the non-null texts of df, the id before them.

    rows(texts) or rows(texts, values of extra) gives, for an Arrow array of texts, the text each row is of and the columns.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        from pyspark.sql.pandas.types import to_arrow_type

        gc.freeze()  # the models and stores hold no cycles; they needn't be walked again and again
        for batch in batches:
            for part in chunks(batch, 1):
                which, columns = rows(*part.columns[1:])
                if len(which):
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *arrays], schema.names)

    more = [F.col(extra).alias("extra")] if extra else []
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).where(F.col("text").isNotNull())
    out = spread(texts).mapInArrow(run, schema)
    return out if id_col == "id" else out.withColumnRenamed("id", id_col)


def replaced(df: DataFrame, text_col: str, change: Callable[[pa.Array], list[str | None]]) -> DataFrame:
    """df with change(texts) in place of its texts; null texts and all other columns stay, and nothing is shuffled."""
    at = df.columns.index(text_col)
    columns = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*columns)  # repeated names don't matter by place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                texts = part.column(at)
                full = pc.is_valid(texts)
                new = iter(change(texts.filter(full)))
                texts = pa.array([next(new) if ok else None for ok in full.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], columns)

    return spread(plain).mapInArrow(run, plain.schema).toDF(*df.columns)


def furniture_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, line_no) of every non-blank line that is furniture; lines count from 1, blank ones included.

    Null, empty and blank texts have none; a line that also holds main text is none; repeated rows are treated each for itself.
    """

    def rows(texts: pa.Array) -> tuple[np.ndarray, list]:
        a = Analysis.of(restored(texts))
        at = np.flatnonzero(a.furniture)
        return a.page[at], [pa.array(a.number[at].astype(np.int32))]

    return mapped(df, id_col, text_col, [T.StructField("line_no", T.IntegerType())], rows)


def main_body(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, body): the text's lines without its furniture; blank lines stay, null texts give no row."""

    def rows(texts: pa.Array) -> tuple[np.ndarray, list]:
        a = Analysis.of(restored(texts))
        raw = pc.split_pattern(texts, "\n")
        kept = np.flatnonzero(~a.furniture)
        bounds = np.searchsorted(a.page[kept], np.arange(len(texts) + 1)).astype(np.int32)
        return np.arange(len(texts)), [pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), raw.flatten().take(pa.array(kept))), "\n")]

    return mapped(df, id_col, text_col, [T.StructField("body", T.StringType())], rows)
