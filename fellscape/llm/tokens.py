"""Encoding of a whole corpus with a published vocabulary (problem 8).

Texts are cut into pre-tokens on the JVM; every distinct pre-token is encoded once, wherever it
stands, and its ids are joined back to its positions. Frequent words (each holding at least
1/``HEAD_WORDS`` of all positions, so at most ``HEAD_WORDS`` of them, of bounded length) come by
broadcast, which keeps hot words out of any shuffle; the others by a shuffled join. Documents are
reassembled by position. Decoding joins the token-byte table of the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HEAD_WORDS, HEAD_BYTES = 1 << 16, 32

#: White space as the vocabulary's pattern has it (fixed values of the Unicode property White_Space).
SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The vocabulary's published pre-token pattern with that class written out.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def single_texts(documents: DataFrame) -> DataFrame:
    """One (doc_id, text) per document: repeated deliveries count once, of differing ones the latest stands."""
    row = F.struct("created_at", "text") if "created_at" in documents.columns else F.struct("text")
    return documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", F.col("r.text").alias("text"))


def pretokens(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, word) of every pre-token; none for null and empty texts."""
    return texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("pos", "word"))


def encode_words(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, n, ids) of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            ids = [enc._encode_single_piece(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word STRING, n BIGINT, ids ARRAY<INT>")


def encode_corpus(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document; empty and null texts have an empty list.

    Special tokens' strings are ordinary text. Repeated rows count once, rows with a null doc_id
    drop out, an empty table gives no rows; texts may be of any length.
    """
    texts = single_texts(documents)
    words = pretokens(texts)
    dictionary = cut(encode_words(words.groupBy("word").agg(F.count("*").alias("n")), path))
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    frequent = (F.col("n") * HEAD_WORDS >= total) & (F.octet_length("word") <= HEAD_BYTES)
    head = F.broadcast(dictionary.where(frequent).select("word", "ids"))
    tail = dictionary.where(~frequent).select("word", F.col("ids").alias("tail_ids"))
    met = words.join(head, "word", "left")
    common = met.where("ids is not null").select("doc_id", "pos", "ids")
    rare = met.where("ids is null").select("doc_id", "pos", "word").join(tail, "word").select("doc_id", "pos", F.col("tail_ids").alias("ids"))
    blank = texts.select("doc_id", F.lit(-1).alias("pos"), F.array().cast("array<int>").alias("ids"))
    pieces = common.unionByName(rare).unionByName(blank)
    return pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p")).select("doc_id", F.flatten("p.ids").alias("ids"))


def token_bytes(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, bytes) of the vocabulary, about 50,000 rows."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(path).items()], "id INT, bytes BINARY")


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of id lists; an empty list is the empty text, an unknown id contributes nothing."""
    table = F.broadcast(token_bytes(encoded.sparkSession, path))  # bounded by the vocabulary
    pieces = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    part = F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce(F.hex("bytes"), F.lit("")).alias("h"))
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return whole.select("doc_id", F.decode(F.unhex(F.array_join("p.h", "")), "UTF-8").alias("text"))
