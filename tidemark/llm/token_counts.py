"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import encoder
from tidemark.llm.common import sub_batches

OUT = ("n_bytes", "n_tokens", "over_limit")


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, batch_bytes: int = 4 << 20, piece_chars: int = 1 << 20) -> DataFrame:
    """Number of tokens of every whole text.

    Returns df without its text column, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of
    these names in df are replaced.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows stay as they are,
    an empty table gives an empty one.  Nothing is shuffled.  Rows are grouped into batches of about batch_bytes, and
    texts longer than piece_chars are cut before blanks between two plain letters, where no token spans (tried for the
    tokenizer on a few words; one for which cuts are not safe gets whole texts).
    """
    kept = [c for c in df.columns if c != text and c not in OUT]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(OUT[0], T.LongType()), T.StructField(OUT[1], T.LongType()), T.StructField(OUT[2], T.BooleanType())])
    inner = "__text"
    while inner in kept:
        inner += "_"

    def run(batches):
        enc = encoder(tokenizer)
        for b in sub_batches(batches, inner, batch_bytes):
            texts = [t or "" for t in b.column(inner).to_pylist()]
            pieces, owner = [], []
            for i, t in enumerate(texts):
                for p in enc.cuts(t, piece_chars):
                    pieces.append(p)
                    owner.append(i)
            n = np.bincount(owner, enc.lengths(pieces), len(texts)).astype(np.int64)
            size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
            cols = [b.column(c) for c in kept] + [pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *OUT])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(inner)).mapInArrow(run, schema)
