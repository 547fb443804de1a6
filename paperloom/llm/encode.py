"""Problem 7: encoding of the whole corpus with a public byte-level tokenizer.

Batches go through the tokenizers library as Arrow columns. Null and empty texts have the
empty list. Strings that look like special tokens are encoded as ordinary text. Decoding
reverses the table from bytes to printable characters; ids that end inside a character decode
to U+FFFD only if the bytes of the whole list do not form one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary lies on every machine; a parameter of all functions.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts given to the library at once, so that its memory does not follow the batch.
CHUNK = 512


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _pieces(path: str) -> dict[int, bytes]:
    table = byte_table()
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return {i: bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode() for piece, i in vocabulary.items()}


def encode_texts(texts: list[str | None], path: str = TOKENIZER) -> list[list[int]]:
    tokenizer = _load(path)
    out: list[list[int]] = []
    for at in range(0, len(texts), CHUNK):
        out += [e.ids for e in tokenizer.encode_batch([t or "" for t in texts[at : at + CHUNK]], add_special_tokens=False)]
    return out


def decode_ids(ids: list[int], path: str = TOKENIZER) -> str:
    pieces = _pieces(path)
    return b"".join(pieces[int(i)] for i in ids).decode("utf-8", errors="replace")


def token_spans(text: str, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """(id, first character, after the last): tokens that split a character share its place."""
    e = _load(path).encode(text or "", add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]


def ids_column(text: Column | str, path: str = TOKENIZER) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encode_texts([t if isinstance(t, str) else None for t in texts], path), index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)


def count_column(text: Column | str, path: str = TOKENIZER) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(x) for x in encode_texts([t if isinstance(t, str) else None for t in texts], path)], index=texts.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType())(text)


def text_column(ids: Column | str, path: str = TOKENIZER) -> Column:
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else decode_ids(list(x), path))

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(ids)


def spans_column(text: Column | str, path: str = TOKENIZER) -> Column:
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "first", "after")]))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"id": i, "first": a, "after": b} for i, a, b in token_spans(t if isinstance(t, str) else "", path)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(text)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(key, ids), one row per row; no shuffle. Other columns are not read."""
    return documents.select(key, ids_column(text, path).alias("ids"))
