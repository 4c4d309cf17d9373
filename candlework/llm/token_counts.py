"""Token counts without token ids.

Pieces are counted once for each distinct pre-token; the counts are joined to the pre-token frequencies of each document
and summed. Both happen in the task that reads the documents: pre-tokens recur so much within a few megabytes that
shuffling (document, pre-token, frequency) rows, about two for every three words of the corpus, would cost far more than
counting a pre-token once in each worker. So the operator has no shuffle and its memory is bounded (_bpe.MOST_KNOWN).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm._bpe import encoder, texts


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens.

    A null text counts as empty. Special tokens' strings inside a text count as the library handles them by default, as
    that one token; nothing is added, cut or padded. Ids may be null or repeat: every row has its result.
    """

    def count(batches):
        known = encoder(tokenizer)
        for batch in batches:
            for data, offsets, low, high in texts(batch.column(1)):
                n = known.count(data, offsets, low, high)
                size = np.diff(offsets[low : high + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(size), pa.array(n)], [doc_id, "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(count, f"`{doc_id}` {kind}, n_bytes long, n_tokens long")
