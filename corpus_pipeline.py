"""A training corpus from `documents`: toxic texts out, near-duplicates out, secrets redacted, the rest packed.

Each stage takes all rows that its predecessor kept and is written as Parquet before the next one reads it.

* toxicity: rows scored 0.7 or more go; labels are learnt from rows whose crc32(doc_id) mod 3 is not 1.
* near_duplicates: of each class of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the row
  with the smallest doc_id stays; rows with a null id stay.
* secrets: spans of secrets become "[secret]"; n_chars follows. No row goes.
* packing: pieces of documents in windows of 2048 tokens.

Null and empty texts are clean and hold no secrets; as they equal each other, one of all texts without words passes
near_duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surefact.llm import packing, secrets, simhash, toxicity
from surefact.llm.common import cut, doc_bucket, dropped, table
from surefact.llm.queries import TOKENIZER

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(doc_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels), threshold=0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("secrets", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            dropped(last)
    return docs
