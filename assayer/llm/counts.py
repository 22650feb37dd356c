"""Token counts: texts are encoded in Arrow functions, and only lengths come back.

Batches are cut by bytes inside the task. For a byte-level tokenizer every distinct word of a
batch is encoded once by the library and a text's count is the sum over its words; a long text
is cut at blanks where a word starts in any case. Other tokenizers get whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words
from assayer.llm.batches import pieces, texts


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)

            def count(column):
                return np.array([len(ids) for ids in model.encode(pc.fill_null(column, "").to_pylist(), num_threads=1)], np.int64)
        else:
            tokenizer = words.load(path)
            if words.is_byte_level(tokenizer):
                known = words.met(path, words.library_encoder(tokenizer))

                def count(column):
                    return words.token_counts(column, tokenizer, known)
            else:
                def count(column):
                    return np.array([len(e) for e in tokenizer.encode_batch_fast(pc.fill_null(column, "").to_pylist(), add_special_tokens=False)], np.int64)
        for batch in pieces(batches):
            column = batch.column("text")
            if batch.num_rows:
                sizes = pc.cast(pc.binary_length(column), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(count(column).astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``tokenizer`` is a .json file of tokenizers or a .model file of sentencepiece, at the same
    place on every executor. No begin or end tokens are added; strings of special tokens inside
    a text are special tokens, as the library's default has it. A null or empty text has no
    bytes and no tokens. Ids may be null or repeat; other columns are not read.
    """
    source = texts(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_counter(tokenizer), f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
