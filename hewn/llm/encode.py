"""Encoding of a whole corpus with a public tokenizer (problem 8).

The rank file is read once per Python worker; texts are encoded whole with the
tiktoken library. Long texts are first cut at safe boundaries, which keeps the
memory of one library call small and never changes an id.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hewn.session import bounded_batches

VOCABULARY_DIR = os.environ.get("HEWN_TOKENIZERS", "/opt/tokenizers")
LONG_TEXT = 1 << 14

# Fixed value: the pre-split pattern published with the vocabulary's rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# No pre-token holds a blank after a non-blank, and none looks back, so a text
# may be cut wherever a blank follows a non-blank.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR):
    """The tiktoken encoding of a local rank file, without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Cuts of ``text`` at safe boundaries, each about ``limit`` long; a stretch without a blank stays whole."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode_text(text: str | None, enc) -> list[int]:
    """Ids of one text; null and empty texts have no ids. Lone surrogates become U+FFFD as in the library."""
    if not text:
        return []
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p in pieces(text):
        out.extend(enc.encode_ordinary(p))
    return out


def decode_ids(ids, enc) -> bytes:
    """The raw UTF-8 bytes of ids; bytes, because one id may hold part of a character."""
    return enc.decode_bytes([int(i) for i in ids])


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR
) -> DataFrame:
    """One row (id, ids) per input row, in a single narrow pass over the table.

    Null and empty texts give an empty list; a text that looks like a special
    token is plain text; repeated rows each give their row; other columns are
    not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoding(vocabulary, folder)
        for b in batches:
            flat, ends = [], np.zeros(b.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(b.column(1)):
                ids = encode_text(text.as_py(), enc)
                flat.append(np.array(ids, dtype=np.int32))
                ends[i + 1] = ends[i] + len(ids)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "ids"])

    return src.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)
