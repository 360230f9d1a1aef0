"""Token counts from distinct pre-tokens (operator 10).

The pieces of each distinct pre-token are counted once with the tokenizer's own library; the counts
are joined to the pre-token frequencies of each document and summed.  No ids are kept anywhere.

A pre-token here is a run of characters between ASCII white space.  That is exact for tokenizers that
drop white space before they merge (``word_bpe``): no rule of theirs reaches over it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every input row gives one row, also
where ids are null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .wordsums import count_words, sum_per_document

LIMIT_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"


def piece_counts(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """Adds ``pieces`` (double) to (word, n): one call of the library per distinct word."""
    source = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source.value)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            pieces = [float(len(e.ids)) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.float64())], ["word", "n", "pieces"])

    return words.select("word", "n").mapInArrow(encode, "word binary, n long, pieces double")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_words (pre-tokens), n_tokens, over_limit for every row."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    words = materialise(piece_counts(count_words(docs, text_col), source), "pieces")
    sums = sum_per_document(docs, words, ["pieces"], id_col, text_col)
    n_tokens = F.col("pieces").cast("long")
    return sums.select(id_col, "n_bytes", "n_words", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
