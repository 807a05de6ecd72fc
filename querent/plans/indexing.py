"""From examples to stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from querent.functions.encoders import hashing_encoder
from querent.operators.bm25 import Bm25Index, build_bm25_index
from querent.operators.corpus import build_index_corpus
from querent.operators.dense import embed, read_vector_index, write_vector_index


def index_vectors(
    examples: DataFrame, path: str, encoder_factory=hashing_encoder(), batch_size: int = 32
) -> DataFrame:
    """Encode the questions on the executors, store the vectors and open them."""
    items = embed(build_index_corpus(examples), "text", encoder_factory, batch_size)
    write_vector_index(items, path)
    return read_vector_index(examples.sparkSession, path)


def index_words(examples: DataFrame, path: str) -> Bm25Index:
    return build_bm25_index(build_index_corpus(examples), path)
