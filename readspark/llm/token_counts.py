"""Token counts of whole texts under a public byte-pair vocabulary.

Method: rank-synchronous array merging (see ``_bpe``): pre-tokens are held as one ragged
numpy array, each merges its lowest-rank pair everywhere at once, and the surviving
symbols are counted. Pieces already met are counted from a worker's bounded memory.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows with a null or
repeated ``doc_id`` are each counted; the input's other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bpe import load
from ._text import blocks, tidy


def token_counts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row; one narrow stage without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for texts in blocks(batch.column(1)):
                n_bytes.append(np.diff(texts.offsets))
                n_tokens.append(bpe.counts(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes)), pa.array(np.concatenate(n_tokens))], ["doc_id", "n_bytes", "n_tokens"])

    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return ids.mapInArrow(tidy(run), f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long")


def over_limit(limit: int) -> Column:
    return F.col("n_tokens") > F.lit(limit)
