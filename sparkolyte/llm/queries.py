"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    avi_media,
    bm25_pack,
    chat_trees,
    chunk_fingerprint,
    jaccard_tree,
    licence_automaton,
    line_dedup,
    pfair_mix,
    quality_mil,
    shared,
    token_store,
)
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_mil.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality_mil.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("select * from values (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) t(conv_id, turn, role, text)", {"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = shared.materialize(chat_trees.format_chats(chat_trees.conversations_as_messages(rows)), "chats")
    read = chat_trees.read_chats(chats)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared.scratch_path(spark, "tokens")
    store = token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), "word", 1)
    return token_store.read_documents(docs, store)


def op5_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.near_duplicates(table(spark, sf_dir, "documents"))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = shared.materialize(avi_media.store_media(table(spark, sf_dir, "documents")), "media")
    cuts = F.transform(F.col("clips"), lambda c: F.concat_ws("-", c["first_frame"], c["last_frame"]))
    grey = F.transform(F.col("mean_histogram"), lambda x: F.round(x * 1000).cast("int").cast("string"))
    return avi_media.read_media(media).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            ";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("clips="), F.concat_ws(",", cuts)), F.concat_ws(",", grey)
        ).alias("feature"),
    )


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bm25_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op10_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_automaton.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Query]:
    found = [
        op1_line_dedup,
        op2_quality_mil,
        op3_chat_trees,
        op4_token_store,
        op5_jaccard_tree,
        op6_avi_media,
        op7_pfair_mix,
        op8_bm25_pack,
        op9_chunk_fingerprint,
        op10_licence_automaton,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op3_chat_trees": chat_trees.SQL, "op7_pfair_mix": pfair_mix.SQL}
