"""Document fingerprints by winnowing: hashes of word grams, the least of every window, with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.common import keyed
from noticeloom.llm.winnow import ascii_lower, gram_codes, likeness, placed_grams, spelled, winnowed, words_of
from noticeloom.operators.ordering import with_global_position
from noticeloom.session import staged

#: Words of a gram and grams of a window: texts that share GRAM + WINDOW - 1 words in a row share a
#: fingerprint.
GRAM, WINDOW = 5, 4


def with_fingerprint(
    rows: DataFrame, text: Column, name: str, length: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """Add ``name``: the chosen grams of a text, one long each, in order of their places.

    Words have A-Z lowered. A null text is empty; a text without words has no grams, one of fewer
    words than a gram is one gram. Equal texts have equal fingerprints. ``winnow.spelled`` writes them as text.
    """
    cut = rows.withColumn(name, words_of(ascii_lower(text)))
    cut = cut.withColumn(name, placed_grams(F.col(name), length))
    return cut.withColumn(name, winnowed(F.col(name), window))


def next_in_order(keys: DataFrame) -> DataFrame:
    """(_key, next, n): the next key in descending order; after the smallest comes the largest."""
    placed = with_global_position(keys.select("_key", "n"), [F.desc("_key")])
    count = F.lit(placed.count())
    here = placed.select("_key", "n", (F.col("position") % count + 1).alias("position"))
    return here.join(placed.select(F.col("_key").alias("next"), "position"), "position").select("_key", "n", "next")


def compare_edited(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = GRAM,
    window: int = WINDOW,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: ``_row``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (floor of characters / 3) replaced by the first as many
    characters of the next document by descending id, or all it has; after the last comes the
    first, and a lone document follows itself. ``near_edited`` and ``near_next`` are the shared part
    of gram hashes with the edited text's and with the next document's fingerprint; two empty
    fingerprints are alike. A null text is empty. See ``keyed`` for null and repeated ids.
    """
    source = keyed(docs, id_col, text_col, carry)
    empty = F.coalesce("_text", F.lit(""))
    texts = source.texts().select("_key", empty.alias("_text"))
    lengths = staged(texts.select("_key", F.char_length("_text").alias("n")), "lengths")
    order = staged(next_in_order(lengths), "order")
    needed = order.select(
        F.col("next").alias("_key"), F.col("_key").alias("user"), "n", F.floor(F.col("n") / 3).cast("int").alias("need")
    )
    # The same columns of the texts meet both joins by key, so they are shuffled once; fingerprints are
    # worked out behind it. Of the next document only its first third and its distinct hashes travel on.
    given = with_fingerprint(texts.join(needed, "_key"), F.col("_text"), "next_chosen", length, window).select(
        F.col("user").alias("_key"),
        "n",
        "need",
        F.substr("_text", F.lit(1), F.col("need")).alias("tail"),
        gram_codes(F.col("next_chosen")).alias("next_codes"),
    )
    both = with_fingerprint(texts.join(given, "_key"), F.col("_text"), "chosen", length, window)
    kept = F.substr("_text", F.lit(1), F.col("n") - F.col("need"))
    edited = both.select("_key", "n", "chosen", "next_codes", F.concat(kept, "tail").alias("edited"))
    marked = with_fingerprint(
        edited.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "edited_chosen", length, window
    ).drop("edited")
    coded = marked.select(
        "_key",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        spelled(F.col("chosen")).alias("fingerprint"),
        spelled(F.col("edited_chosen")).alias("edited_fingerprint"),
        gram_codes(F.col("chosen")).alias("codes"),
        gram_codes(F.col("edited_chosen")).alias("edited_codes"),
        "next_codes",
    )
    found = coded.select(
        "_key",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
    if source.unique and carry == [id_col]:
        return found.select(F.struct(F.col("_key").alias(id_col)).alias("_row"), *found.columns[1:])
    return source.rows.select("_key", "_row").join(found, "_key").drop("_key")
