"""From raw documents to piece numbers: identify, dedupe, cut repeats, decontaminate, encode.

Every stage takes all rows its predecessor kept and decides on them alone. All but the last return
the columns of ``documents``; further columns of the input are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.llm.decontaminate import decontaminate
from noticeloom.llm.language_id import held_out, identify, train
from noticeloom.llm.minhash import minhash_dedup
from noticeloom.llm.pieces import encode_texts
from noticeloom.llm.substring_dedup import substring_dedup
from noticeloom.session import scratch

#: A document goes when no language has at least this posterior, or it has no letter at all.
LEAST_SCORE = 0.5
#: It goes as well when its words are this much unlike those of all languages together, as noise, random
#: letters and unseen scripts are; prose of a learned language has over 0.99.
LEAST_FAMILIAR = 0.5
#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def _as_documents(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The carried columns in their old order, with the text put back."""
    return rows.select(*[F.col(text).alias("text") if name == "text" else F.col(f"_row.`{name}`") for name in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, without a clear language or unlike any language learned."""
    model = train(docs.filter(~held_out()))
    found = identify(docs, model, keep_text=True)
    # With nothing to learn from there is no ground to reject a text that has letters.
    clear = (F.col("score") >= LEAST_SCORE) & (F.col("familiar") >= LEAST_FAMILIAR)
    kept = clear if model.languages else F.col("_text").rlike(r"\p{L}")
    return _as_documents(found.filter(kept), "_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every near-duplicate group on five-word shingles, repeated rows once."""
    found = minhash_dedup(docs, width=SHINGLE)
    kept = found.filter("kept").select(*[F.col(f"_row.`{name}`") for name in docs.columns])
    return kept.dropDuplicates(["doc_id", "text"]) if _repeated(docs) else kept


def _repeated(docs: DataFrame) -> bool:
    """Whether an id stands in more than one row; without that no row repeats."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of windows that an earlier document has; ``n_chars`` follows the new text."""
    found = substring_dedup(docs)
    return _recounted(_as_documents(found, "kept_text", docs.columns), docs)


def _recounted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return rows
    kind = docs.schema["n_chars"].dataType
    return rows.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(kind))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark, keep_text=True)
    return _as_documents(found.filter(~F.col("contaminated")), "_text", docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every text, with the check that they decode to it."""
    found = encode_texts(docs)
    names = [name for name in docs.columns if name != "text"]
    return found.select(
        *[F.col(f"_row.`{name}`") for name in names],
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        "round_trip",
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", benchmarks),
    ("sentencepiece", encode),
]

#: Language models and piece merges have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return found
        path = scratch(spark, f"stage-{number}-{name}")
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
