"""Problem 2: pages of template residue, dummy copy and messages.

The parts (a sentence, or a line without sentence ends) of all pages are mined as message templates. A fixed-depth prefix tree
(number of words, then the first DEPTH words, names and numbers masked) parts them into leaves, and in a leaf the word that
most rows have at a place is kept and the other places become wildcards: an outcome that doesn't hang on the order of rows.
Each template is classified once, by what the line classifier finds in all its rows together, and its verdict goes to all its
parts; a part alone in its template has the verdict that the classifier gave it. Unresolved slots are found in ordinary
records by their spelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import linemodel, pages
from quern.session import cut, salted_lookup, spread, written

#: Words of a part that lead through the prefix tree.
DEPTH = 2
#: A place of a leaf keeps its most frequent word if so many of the rows have it; a part belongs to the template if it has so many of its words.
MAJORITY, SIMILAR = 0.5, 0.6
#: Verdicts: main text of its own, residue, and what is neither (furniture, names, labels, bylines).
CONTENT, RESIDUE, NEUTRAL = 2, 1, 0


@dataclass
class Parts:
    """The parts of some pages that aren't furniture by their place, each with its page and its own verdict."""

    page: np.ndarray
    code: np.ndarray  # its place among the parts of the distinct lines
    verdict: np.ndarray

    @classmethod
    def of(cls, a: pages.Analysis) -> Parts:
        own = a.distinct
        verdicts = verdicts_of(own)
        # the parts of each distinct line lie together
        first = np.searchsorted(own.parts.text, np.arange(len(own.lines) + 1))
        at = np.flatnonzero((a.code >= 0) & ~a.boxed)
        n = np.diff(first)[a.code[at]]
        code = np.repeat(first[a.code[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return cls(np.repeat(a.page[at], n), code, verdicts[code])

    def most(self, n_pages: int) -> np.ndarray:
        """The greatest verdict of each page, each part judged for itself."""
        out = np.zeros(n_pages, np.int64)
        np.maximum.at(out, self.page, self.verdict)
        return out


def judged(seg: linemodel.Segments) -> np.ndarray:
    """The verdict of each segment from the line classifier's probabilities for its words."""
    kind = seg.p.argmax(1)
    out = np.where(kind == pages._M, RESIDUE, np.where((kind == pages._C) | (kind == pages._T), CONTENT, NEUTRAL))
    out = np.where(seg.unknown == seg.alpha, np.where(seg.size <= 4, NEUTRAL, CONTENT), out)
    sure = (seg.alpha > pages.LEAST_WORDS + 1) & (seg.p[:, pages._C] > 0.5)
    return np.where(seg.slots > 0, np.where(sure, CONTENT, RESIDUE), np.where(seg.size == 0, NEUTRAL, out))


def verdicts_of(lines: pages.Lines) -> np.ndarray:
    """The verdict of the parts of distinct lines; the sentences of a line of furniture are no main text."""
    seg = lines.parts
    verdict = judged(seg)
    away = np.isin(lines.kind, (pages._F, pages._B, pages._P))[seg.text]
    return np.where(away & (verdict == CONTENT), NEUTRAL, verdict)


_VOTES = ("neutral", "residue", "content")
_UNITS = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("masked", T.StringType()), T.StructField("own", T.IntegerType()), T.StructField("fixed", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in _VOTES]])
#: Up to so many masked parts with another verdict than their template's are broadcast by their hashes; more are joined by a shuffle.
BROADCAST = 200_000


def votes(seg: linemodel.Segments) -> np.ndarray:
    """The log probabilities of each segment for the verdicts in order."""
    p = seg.p.astype(float)
    return np.log(np.stack([p[:, [pages._F, pages._B, pages._P]].max(1), p[:, pages._M], p[:, [pages._C, pages._T]].max(1)], 1) + 1e-4)


def undecided_parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (words, path, masked, own, fixed, votes, pages) of the distinct parts of each batch, with all pages (id, row) they are on.

    row tells texts of one id apart; own is the part's own verdict, fixed where it stays whatever its template is: with slots, or
    without a known word. No page is left out before the templates are mined.
    """
    page_of = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("row", T.LongType())])
    schema = T.StructType([*_UNITS.fields, T.StructField("pages", T.ArrayType(page_of))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pages.chunks(batch, 1):
                a = pages.Analysis.of(pages.restored(part.column(1)))
                p = Parts.of(a)
                seg = a.distinct.parts
                pairs = np.unique((p.page * len(seg) + p.code)[(seg.size + seg.slots > 0)[p.code]])
                if not len(pairs):
                    continue
                page, code = np.divmod(pairs, len(seg))
                order = np.argsort(code, kind="stable")
                code, first = np.unique(code[order], return_index=True)
                at = pa.array(page[order])
                where = pa.StructArray.from_arrays([part.column(0).take(at), part.column(2).take(at)], ["id", "row"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), where)
                texts, chances = seg.masked(code), votes(seg)[code]
                words = [x.split() for x in texts]
                fixed = ((seg.slots > 0) | (seg.alpha == seg.unknown))[code]
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(w) for w in words], pa.int32()), pa.array([" ".join(w[:DEPTH]) for w in words], pa.string()), pa.array(texts, pa.string()),
                    pa.array(verdicts_of(a.distinct)[code].astype(np.int32)), pa.array(fixed), *[pa.array(chances[:, k]) for k in range(3)], lists,
                ], schema.names)

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")).where(F.col("text").isNotNull())
    return spread(texts).mapInArrow(run, schema)


def templates(units: DataFrame) -> DataFrame:
    """Rows (masked, template, n_rows, votes) of the distinct masked parts, by the word most rows have at each place of a leaf.

    A unit with a list of pages counts once for each of them.

    Places and words are counted before the shuffle, so a leaf may hold any share of the parts. A part that has less than
    SIMILAR of its leaf's kept words is its own template.
    """
    n_rows = F.sum(F.size("pages")) if "pages" in units.columns else F.count("*")
    distinct = cut(units.groupBy("words", "path", "masked").agg(n_rows.alias("n_rows"), *[F.max(c).alias(c) for c in _VOTES]))
    places = distinct.select("words", "path", "n_rows", F.posexplode(F.split("masked", " ")).alias("place", "word"))
    counts = places.groupBy("words", "path", "place", "word").agg(F.sum("n_rows").alias("n"))
    tops = counts.groupBy("words", "path", "place").agg(F.max(F.struct("n", "word")).alias("top"), F.sum("n").alias("total"))
    kept = F.when(F.col("top.n") >= MAJORITY * F.col("total"), F.col("top.word")).otherwise("*")
    # a leaf's places are as many as its words, whatever its number of rows
    leaves = tops.groupBy("words", "path").agg(F.array_sort(F.collect_list(F.struct("place", kept.alias("word")))).alias("places"), F.max("total").alias("n_leaf"))
    leaves = leaves.select("words", "path", F.transform("places", lambda x: x["word"]).alias("kept"))
    sizes = distinct.groupBy("words", "path").agg(F.count("*").alias("n_rows"))
    rows = salted_lookup(distinct.withColumnRenamed("n_rows", "n_own"), leaves.join(sizes, ["words", "path"]), ["words", "path"])
    own = F.split("masked", " ")
    fixed = F.filter(F.zip_with(own, "kept", lambda a, b: F.when(b != "*", (a == b).cast("int"))), lambda x: x.isNotNull())
    fits = F.aggregate(fixed, F.lit(0), lambda x, y: x + y) >= SIMILAR * F.size(fixed)
    enough = F.size(fixed) >= SIMILAR * F.col("words")
    template = F.when(fits & enough, F.array_join("kept", " ")).otherwise(F.col("masked"))
    return rows.select("masked", template.alias("template"), F.col("n_own").alias("n_rows"), *_VOTES)


def found(df: DataFrame, id_col: str, text_col: str, merge: bool = True) -> DataFrame:
    """The ids of pages whose main body holds residue and nothing of its own.

    A page needs at least one part of residue and none of main text; furniture, bare names, labels, bylines and share prompts
    count for neither. Headings right after the title of a link box belong to the box. Null, empty and blank texts are no
    cases; a long text is read whole; texts that share an id are judged apart. Without merge each part is judged for itself.
    """
    return _found(df, id_col, text_col, merge).select(F.col("id").alias(id_col)).distinct()


def _found(df: DataFrame, id_col: str, text_col: str, merge: bool = True) -> DataFrame:
    units = written(undecided_parts(df, id_col, text_col))
    # each page's parts of main text and of residue, added up where they are read; what templates change is added to them
    sums = _by_page(units, F.col("own") == CONTENT, F.col("own") == RESIDUE)
    if merge:
        changed = cut(changed_verdicts(units))
        keys = [F.xxhash64("masked").alias("k1"), F.xxhash64("masked", F.lit(1)).alias("k2")]
        # the sentences of a line of furniture are no main text, whatever their template is elsewhere
        moved = units.where(~F.col("fixed")).select(*keys, "own", "pages")
        lookup = changed.select(*keys, "verdict", "n_rows")
        if changed.count() <= BROADCAST:
            moved = moved.join(F.broadcast(lookup.drop("n_rows")), ["k1", "k2"])
        else:
            moved = salted_lookup(moved, lookup, ["k1", "k2"])
        moved = moved.where((F.col("own") != F.col("verdict")) & ~((F.col("own") == NEUTRAL) & (F.col("verdict") == CONTENT)))
        change = lambda kind: (F.col("verdict") == kind).cast("long") - (F.col("own") == kind).cast("long")
        sums = sums.unionByName(_by_page(moved, change(CONTENT), change(RESIDUE)))
        sums = sums.groupBy("id", "row").agg(F.sum("content").alias("content"), F.sum("residue").alias("residue"))
    return sums.where("content = 0 AND residue > 0").select("id", "row")


def _by_page(units: DataFrame, content: Column, residue: Column) -> DataFrame:
    """Rows (id, row, content, residue) of the pages of units: the sums of two columns."""
    rows = units.select(content.cast("long").alias("content"), residue.cast("long").alias("residue"), F.explode("pages").alias("page"))
    return rows.groupBy(F.col("page.id").alias("id"), F.col("page.row").alias("row")).agg(F.sum("content").alias("content"), F.sum("residue").alias("residue"))


def changed_verdicts(units: DataFrame) -> DataFrame:
    """Rows (masked, verdict, n_rows) of the masked parts whose template, judged by all its rows, has another verdict than they have."""
    verdict = (F.array_position(F.array(*_VOTES), F.greatest(*_VOTES)) - 1).cast("int")
    mined = cut(templates(units))
    total = mined.groupBy("template").agg(*[F.sum(F.col(c) * F.col("n_rows")).alias(c) for c in _VOTES], F.count("*").alias("n_masked"))
    # a part alone in its template has its own verdict
    judged_once = total.where("n_masked > 1").select("template", verdict.alias("verdict"), F.col("n_masked").alias("n_rows"))
    known = salted_lookup(mined.select("masked", "template", F.col("n_rows").alias("n"), verdict.alias("alone")), judged_once, ["template"])
    return known.where("verdict <> alone").select("masked", "verdict", F.col("n").alias("n_rows"))


def is_residue(a: pages.Analysis) -> np.ndarray:
    """Whether each page of an analysis is residue, each part judged for itself."""
    return Parts.of(a).most(len(a.counts)) == RESIDUE


def cleaned(texts: pa.Array) -> list[str]:
    """The texts without their parts of slots and messages, judged as restored; what stays is as it was."""
    own = pages.restored(texts)
    a = pages.Analysis.of(own)
    seg = a.distinct.parts
    gone = judged(seg) == RESIDUE
    n_gone = np.bincount(seg.text[gone], minlength=len(a.distinct.lines))
    n_parts = np.bincount(seg.text, minlength=len(a.distinct.lines))
    raw = pc.split_pattern(texts, "\n").flatten().to_pylist()
    lines = a.distinct.lines
    first = np.searchsorted(seg.text, np.arange(len(lines) + 1))
    out: list[list[str]] = [[] for _ in range(len(texts))]
    for k, (page, code) in enumerate(zip(a.page.tolist(), a.code.tolist(), strict=True)):
        line = raw[k]
        if code >= 0 and n_gone[code]:
            if n_gone[code] == n_parts[code]:
                continue
            # a part's words in the raw line, or in the restored one where that has other words
            for words in (line.split(), lines[code].as_py().split()):
                if a.distinct.slotted[code]:
                    words = linemodel.SLOT.sub(f" {linemodel.SLOT_MARK} ", " ".join(words)).split()
                if len(words) == int(seg.n_words[first[code] : first[code + 1]].sum()):
                    break
            kept, at = [], 0
            for part in range(first[code], first[code + 1]):
                if not gone[part]:
                    kept += words[at : at + int(seg.n_words[part])]
                at += int(seg.n_words[part])
            line = " ".join(w for w in kept if w != linemodel.SLOT_MARK)
        out[page].append(line)
    return ["\n".join(x) for x in out]


def without_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the pages that found lists, and without the parts of slots and messages in the others.

    Null texts, other columns and repeated rows stay. The texts are moved once at most, to leave out the pages found.
    """
    gone = _found(df, id_col, text_col).select(F.col("id").alias("__id"), F.col("row").alias("__row"))
    marked = df.withColumn("__key", F.xxhash64(text_col))
    kept = marked.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left_anti").drop("__key")
    return pages.replaced(kept, text_col, cleaned)
