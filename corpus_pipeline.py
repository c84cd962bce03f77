"""A training-data pipeline from raw documents to packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on
all that its predecessor kept. All but the last return the columns of documents, whatever
others there are and whatever their names.

What becomes of odd rows: null text is empty text throughout, and is packed as one token
if it stays; rows with a null doc_id go through all stages like others, but are not
learned from; of rows repeated with one doc_id and text, and of equal texts under any
ids, one stays; of ids that tie the smallest stays, null last; a row with an id that
occurs with another text as well is a row of its own. Very long texts stay whole and are
packed in pieces. Without labels of both classes no text is toxic, unless all are. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annoweave.llm import exact_dedup, mixing, packing, simhash, toxicity
from annoweave.llm.base import read_table
from annoweave.llm.queries import BUDGET, SHINGLE, tokenizer_path
from annoweave.session import shared_folder
from annoweave.sources.sinks import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, SHINGLE, BUDGET)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and hashes of this kind have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are stored in the shared folder and deleted once the next has read them."""
    folder = shared_folder(spark, "corpus_pipeline")
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # packing has stored its pieces; nothing reads the texts any more
    return packed
