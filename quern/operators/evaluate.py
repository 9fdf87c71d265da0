"""Pluggable evaluators and translators, run over partitions with each failure kept beside its row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Evaluator = Callable[[str, str], dict[str, float]]


def hashed_evaluator(criteria: Sequence[str]) -> Evaluator:
    """An offline evaluator whose probabilities are a hash of text and criterion: for tests and dry runs."""

    def evaluate(subject: str, text: str) -> dict[str, float]:
        return {c: int.from_bytes(hashlib.sha256(f"{c}\n{text}".encode()).digest()[:4], "big") % 10_001 / 10_000 for c in criteria}

    return evaluate


def evaluated(chunks: DataFrame, evaluator: Evaluator) -> DataFrame:
    """chunks (subject, chunk_no, text) with probabilities, or stage, error_type and message where the evaluator failed.

    One row's failure ends no task. The evaluator is called once a row; Arrow batches carry the rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    out.append((row.subject, row.chunk_no, evaluator(row.subject, row.text or ""), None, None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((row.subject, row.chunk_no, None, "evaluate", type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["subject", "chunk_no", "probabilities", "stage", "error_type", "message"])

    schema = f"subject string, chunk_no {dict(chunks.dtypes)['chunk_no']}, probabilities map<string,double>, stage string, error_type string, message string"
    return chunks.select("subject", "chunk_no", "text").mapInPandas(run, schema)


Translator = Callable[[str, str], tuple[str, int]]


def identity_translator(text: str, hint: str) -> tuple[str, int]:
    """The text as it is, billed by its length: for tests and dry runs."""
    return text, len(text)


def translated(chunks: DataFrame, translator: Translator, mode: str = "auto") -> DataFrame:
    """chunks (site, request, pages, ...) with translated pages, translations and billed_characters, or stage, error_type and message.

    mode auto leaves pages hinted English as they are, all translates every page. translations: (page_index, url, status,
    source_characters, billed_characters) by page. A chunk whose translator fails keeps its pages and names the failure.
    """
    if mode not in ("auto", "all"):
        raise ValueError("mode must be auto or all")
    kinds = dict(chunks.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pages, notes, error = [dict(p) for p in row.pages], [], (None, None, None)
                try:
                    for k, p in enumerate(pages):
                        hint = (p["language_hint"] or "").lower().replace("_", "-")
                        done = mode == "all" or not (hint == "en" or hint.startswith("en-"))
                        size, billed = len(p["text"]), 0
                        if done:
                            p["text"], billed = translator(p["text"], p["language_hint"])
                        notes.append({"page_index": k, "url": p["url"], "status": "translated" if done else "kept", "source_characters": size, "billed_characters": billed})
                except Exception as e:  # noqa: BLE001
                    pages, notes, error = [dict(p) for p in row.pages], [], ("translate", type(e).__name__, str(e))
                out.append((row.site, row.request, pages, notes, sum(n["billed_characters"] for n in notes), *error))
            yield pd.DataFrame(out, columns=["site", "request", "pages", "translations", "billed_characters", "stage", "error_type", "message"])

    note = "array<struct<page_index:int,url:string,status:string,source_characters:int,billed_characters:long>>"
    return chunks.select("site", "request", "pages").mapInPandas(run, f"site string, request {kinds['request']}, pages {kinds['pages']}, translations {note}, billed_characters long, stage string, error_type string, message string")


def joined_text(pages: Column) -> Column:
    """The pages of a chunk as one text, for evaluators that take texts."""
    return F.array_join(F.transform(pages, lambda p: p["text"]), "")
