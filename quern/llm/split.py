"""Problem 1: oversized texts cut at natural boundaries by content-defined chunking.

A rolling hash over the last WINDOW code points marks landmarks. From one cut on, the strongest landmark between the smallest
and the largest size is taken and snaps to the nearest natural boundary (end of a paragraph, else of a line, a sentence, a
word) inside those sizes. Landmarks depend on the text around them alone, so an edit moves only the cuts near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 32
#: Ends of a paragraph, a line, a sentence and a word; the cut comes after the match.
_BOUNDARIES = (re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+"), re.compile(r"\n"), re.compile(r"[.!?…]+[\"'”’»)\]]*\s+"), re.compile(r"\s+"))


def landmarks(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each position, of the WINDOW code points before it."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(codes) + 1, np.uint64)
    for k in range(min(WINDOW, len(codes))):
        total[k + 1 :] += mixed[: len(codes) - k] << np.uint64(k % 31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total >> np.uint64(32)).astype(np.uint32)


def cuts(text: str, limit: int, overlap: int, minimum: int) -> list[int]:
    """Positions where the pieces of text end; the last is its length. Each piece but the first starts overlap before its predecessor's end."""
    n = len(text)
    if n <= limit:
        return [n]
    marks = landmarks(np.fromiter(map(ord, text), np.uint32, n))
    ends = [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in _BOUNDARIES]
    out, at = [], 0
    while n - at + (overlap if out else 0) > limit:
        top = at + limit - (overlap if out else 0)
        low = min(at + minimum, top)
        mark = low + int(np.argmax(marks[low : top + 1]))
        for b in ends:
            i, j = np.searchsorted(b, [low, top + 1])
            if i < j:
                near = b[i:j]
                mark = int(near[np.argmin(np.abs(near - mark))])
                break
        out.append(mark)
        at = mark
    return [*out, n]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 6000, overlap: int = 200, minimum: int | None = None) -> DataFrame:
    """Rows (id, piece_no, n_pieces, start, end, piece) for each text of df, white space at both ends not counted.

    Texts of at most limit code points come whole, longer ones in pieces of at most limit, numbered from 1; consecutive pieces
    share exactly overlap code points, and start and end are offsets in the stripped text. Null, empty and blank texts give no
    rows; repeated rows are split each for itself. minimum is the smallest advance of a cut, by default half the limit.
    """
    least = limit // 2 if minimum is None else minimum
    if not 0 <= overlap < least <= limit - overlap:
        raise ValueError("needs 0 <= overlap < minimum <= limit - overlap")
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text.strip()
                if not text:
                    continue
                stops, at = cuts(text, limit, overlap, least), 0
                for p, stop in enumerate(stops):
                    start = max(0, at - overlap) if p else 0
                    which.append(k)
                    rows.append((p + 1, len(stops), start, stop, text[start:stop]))
                    at = stop
            if rows:
                no, total, start, end, piece = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(no, pa.int32()), pa.array(total, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(piece)], ["id", "piece_no", "n_pieces", "start", "end", "piece"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col) if id_col != "id" else texts.mapInArrow(run, schema)


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 6000, overlap: int = 200) -> DataFrame:
    """The ids of texts that split_oversized cuts; texts no longer than limit even with their white space are left out in the scan."""
    pieces = split_oversized(df.where(F.length(text_col) > limit), id_col, text_col, limit, overlap)
    return pieces.where("piece_no = 1 AND n_pieces > 1").select(id_col)
