"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, written

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
ENCODE_BYTES = 1 << 18


def _encoder(name: str):
    """texts -> counts, for a file of public_tokenizers: sentencepiece for .model, tokenizers for .json."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    if str(path).endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path))
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(path))
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(name: str) -> str:
    """The digest of a tokenizer's file, which names its version in the cache."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _first_of_each(batches):
    """Rows whose content digest this task has not passed on yet."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        if any(keep):
            yield batch.filter(pa.array(keep))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    The content is normalised to its UTF-8 bytes (null: none; nothing else, since any other change could
    change the count) and digested with the tokenizer file's digest beside it. Digests the cache at
    ``cache_path`` holds are not encoded; of the rest each distinct content is encoded once and appended.
    Copies are dropped in the reading tasks before the shuffle, so a frequent content is sent at most once
    by each of them. A null id, repeated ids and repeated rows each keep their row; no rows give none.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    body = F.coalesce(F.col("text"), F.lit(""))
    content = F.unhex(F.sha2(body.cast("binary"), 256)).alias("content")
    ids = written(docs.select("doc_id", content, F.octet_length(body).cast("long").alias("n_bytes")), "digests")
    texts = docs.select(content, body.alias("body")).mapInArrow(_first_of_each, "content binary, body string")
    if _exists(spark, cache_path):
        known = spark.read.parquet(cache_path).where(F.col("tokenizer") == version)
        texts = texts.join(known.select("content"), "content", "left_anti")

    def encode(batches):
        count = None
        for batch in _first_of_each(batches):
            count = count or _encoder(tokenizer)
            bodies, at, counts = batch.column(1), 0, []
            while at < len(bodies):
                part, size = [], 0
                while at < len(bodies) and (not part or size < ENCODE_BYTES):
                    part.append(bodies[at].as_py())
                    size += len(part[-1])
                    at += 1
                counts += count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])

    fresh = texts.repartition("content").mapInArrow(encode, "content binary, tokenizer string, n_tokens long")
    fresh.write.mode("append").parquet(cache_path)
    known = spark.read.parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    return ids.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through a cache that starts empty."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), new_path(spark, "token-cache"))
