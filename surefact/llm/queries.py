"""The queries of this subpackage, opN_<name>, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licences, media, neighbours, ngrams, packing, secrets, simhash, toxicity, warc
from .common import cut, doc_bucket, table

TOKENIZER = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(cut(media.store(table(spark, sf_dir, "documents"))))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = F.col("phrases.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"), F.array_max("phrases.start").alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))).alias("score"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), min_revisit=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(doc_bucket(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines"
    )


def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents"), doc_bucket(F.col("doc_id"), 10) != 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP7_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), r as (
  select payload_digest, max(page_id) as response from p where payload_bytes >= 1000 group by payload_digest having count(*) > 1
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when response is not null and page_id <> response then 'revisit' else 'response' end as record_type,
       case when page_id <> response then response end as refers_to
from p left join r using (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL}
