"""Problem 8: the corpus as token ids of a public byte-level BPE tokenizer.

The tokenizers library's model runs over Arrow batches. A byte-level vocabulary spells each byte as one printable character;
each distinct pre-token is spelled that way and encoded once per task, and the ids of a text are put together from its
pre-tokens. Texts with characters whose class may differ between Unicode versions go through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens kept per task; at the bound the store starts afresh, which changes speed alone.
STORED = 400_000
#: Fixed values of the tokenizer: its pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose characters have had their classes since the first versions of Unicode.
_OLD = re.compile("[\t\n\r -~\xa0-ȳΑ-ΡΣ-ώА-я‐-‧‰-⁞₠-€←-⇿─-◿]*")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Encoder:
    """Token ids of texts, with pre-tokens encoded once."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the pattern and the byte spelling are those of this kind alone
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        if parts["model"]["type"] != "BPE" or parts["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"no byte-level BPE tokenizer with the usual pattern: {path}")
        self.tokenizer.encode_special_tokens = True
        self.pieces = regex.compile(PATTERN).findall
        self.spelling = byte_characters()
        self.store: dict[str, list[int]] = {}

    def encode_pretoken(self, piece: str) -> list[int]:
        spelling = self.spelling
        return [t.id for t in self.tokenizer.model.tokenize("".join(spelling[b] for b in piece.encode()))]

    def ids(self, text: str) -> list[int]:
        if not _OLD.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces, store = self.pieces(text), self.store
        try:
            return list(chain.from_iterable([store[p] for p in pieces]))
        except KeyError:
            if len(store) > STORED:
                store.clear()
            for p in pieces:
                if p not in store:
                    store[p] = self.encode_pretoken(p)
            return list(chain.from_iterable([store[p] for p in pieces]))

    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in enumerate(self.spelling)}
        size = self.tokenizer.get_vocab_size()
        out = []
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """Rows (id, ids) of df: the ids of each text without special tokens; null and empty texts give an empty list, never null.

    A special token's spelling inside a text is ordinary text. Repeated rows come as often as they stand in df.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            lists = [encoder.ids(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])

    out = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def encode_with_offsets(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """As encode, with starts and ends: each token's byte offsets in the UTF-8 text, and char_starts, the code points begun before it.

    A token that starts inside a character has the offset of that character in char_starts.
    """
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(c, ints, False) for c in ("ids", "starts", "ends", "char_starts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        sizes = np.array([len(b) for b in encoder.token_bytes()])
        for batch in batches:
            out: list[list[list[int]]] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = encoder.ids(text) if text else []
                ends = np.cumsum(sizes[ids]) if ids else np.zeros(0, np.int64)
                starts = ends - sizes[ids] if ids else ends
                raw = np.frombuffer((text or "").encode(), np.uint8)
                begun = np.cumsum((raw & 0xC0) != 0x80) - 1
                for k, x in enumerate((ids, starts.tolist(), ends.tolist(), begun[starts].tolist() if ids else [])):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in out]], ["id", "ids", "starts", "ends", "char_starts"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str = TOKENIZER) -> DataFrame:
    """Rows (id, text): the text of each list of ids, by the reversed byte table.

    Characters split over tokens are put together again, as bytes are joined before decoding; bytes that make no character
    become U+FFFD. Null and empty lists give the empty text; an id outside the vocabulary is an error.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(path).token_bytes()
        for batch in batches:
            texts = [b"".join([table[i] for i in x or []]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
