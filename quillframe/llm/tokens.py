"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import name_free

#: Vocabulary of the byte-level tokenizer, a parameter of every operator that measures; the variable sets another default.
VOCABULARY = os.environ.get("QUILLFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the public vocabulary's tokenizer splits a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(vocabulary: str):
    import tiktoken

    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: pass the path of a .tiktoken file that every worker has, or set QUILLFRAME_VOCABULARY")
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): every document once; a null text has no tokens.

    Texts are measured where they are read, so repeated rows meet as numbers and no text is shuffled.
    """
    rows = name_free(documents, "doc_id", "source", "text").where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    measured = rows.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, tokens long")
    best = measured.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m"))
    return best.select("doc_id", "m.source", "m.tokens")


def hash_unit(*columns) -> F.Column:
    """A number in [0, 1) from the columns, the same in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))
