"""The operators bound to the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.llm.chat import Template, format_chats, read_loss, read_turns
from noticeloom.llm.decontaminate import decontaminate
from noticeloom.llm.fingerprints import compare_edited
from noticeloom.llm.language_id import held_out, identify, train
from noticeloom.llm.licenses import scan_licenses
from noticeloom.llm.merkle import lowered_leaf, manifest
from noticeloom.llm.minhash import minhash_dedup
from noticeloom.llm.mixing import mix_sources, taken_words
from noticeloom.llm.oracles import merkle, repair
from noticeloom.llm.pieces import encode_texts
from noticeloom.llm.repair import audits, damaged, repair_conversations
from noticeloom.llm.sharding import shard_documents
from noticeloom.llm.substring_dedup import substring_dedup
from noticeloom.llm.suffix_dedup import suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_texts(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        "_row.doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


SQL_CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '\\', '\\e'), '<|im_start|>', '\\l|im_start|>'), '<|im_end|>', '\\l|im_end|>'),
      '<|endoftext|>', '\\l|endoftext|>'), '<s>', '\\ls>'), '</s>', '\\l/s>'), '[INST]', '\\sINST]'),
      '[/INST]', '\\s/INST]'), '<<SYS>>', '\\l<SYS>>'), '<</SYS>>', '\\l</SYS>>') AS safe
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before FROM escaped),
stepped AS (
  SELECT *, (before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
                               ('assistant', 'user')) AS allowed FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + length(role) + 24) AS BIGINT) AS formatted_chars,
       count(*) FILTER (NOT allowed) = 0 AND max_by(role, place) = 'assistant' AS valid,
       CAST(min(place) FILTER (NOT allowed) AS BIGINT) AS bad_step
FROM stepped GROUP BY conv_id
"""


@query("op2_chat_formatting", SQL_CHAT)
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    template = Template()
    names = ["conv_id", "turn", "role", "text"]
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    turns = table(spark, folder, "conversations").select(*names).unionByName(own)
    found = format_chats(turns, template)
    read = found.select(
        "conv_id",
        "valid",
        "bad_step",
        read_turns(F.col("formatted"), template).alias("turns"),
        read_loss(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    line = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        F.col("bad_step").cast("long").alias("bad_step"),
    )


@query("op3_sharding")
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_documents(table(spark, folder, "documents"), 40, carry=["doc_id"], keep_text=False)
    return found.select("_row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup(table(spark, folder, "documents"), spell=False, carry=["doc_id"])
    spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("_row.doc_id", "n_bytes", "n_removed", spans, "kept_sha256")


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"), carry=["doc_id"])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("_row.doc_id", *names, F.size("spans").cast("long").alias("n_spans"))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark),
items AS (SELECT item_id, words, least(len(words), 10) AS size FROM b WHERE len(words) > 0),
item_windows AS (
  SELECT item_id, size, array_to_string(words[pos:pos + size - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, CAST(len(words) - size + 2 AS BIGINT))) AS pos FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
doc_windows AS (
  SELECT doc_id, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, CAST(len(words) - size + 2 AS BIGINT))) AS pos
        FROM d, sizes WHERE len(words) >= size)),
hits AS (
  SELECT doc_id, pos, h.size AS size, item_id FROM doc_windows h JOIN item_windows i ON h.w = i.w AND h.size = i.size),
hit_words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, CAST(pos + size AS BIGINT))) AS word FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op6_benchmark_decontamination", SQL_DECONTAMINATE)
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontaminate(docs, benchmark, carry=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_document_fingerprints")
def op7_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = compare_edited(table(spark, folder, "documents"), carry=["doc_id"])
    return found.select("_row.doc_id", *found.columns[1:])


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_dedup(table(spark, folder, "documents"), carry=["doc_id"], width=2)
    return found.select("_row.doc_id", "n_shingles", "component_id", "kept")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(table(spark, folder, "documents"), spell=False, carry=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, carry=["doc_id"])
    return found.select("_row.doc_id", held_out("_row.doc_id").alias("held_out"), "lang_pred", "score")


@query("op11_conversation_repair", repair())
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair_conversations(damaged(turns))
    found = fixed.conversations.join(audits(fixed), "start").withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op12_source_mixing")
def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_sources(table(spark, folder, "documents"), carry=["doc_id"], keep_text=False)
    names = ["size", "source_size", "target", "taken", "n_draws", "first_shard", "last_shard"]
    return taken_words(mix).select("_row.doc_id", *names)


@query("op13_merkle_manifest", merkle())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = lowered_leaf(columns, "text", "doc_id")
    found = manifest(docs, columns, carry=["doc_id"], tampered=tampered, keep_path=False)
    return found.select("_row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
