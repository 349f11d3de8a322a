"""Benchmark decontamination by winnowing: shared fingerprints find documents, windows decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.common import keyed
from noticeloom.llm.winnow import ascii_lower, gram, positions, sliding_least, words_of
from noticeloom.session import staged

#: Words of a window, and of the grams whose least hash names it.
WINDOW, GRAM = 10, 5


def _anchors(words: Column, grams: Column, window: int, length: int) -> Column:
    """The name of every window: the least hash of its grams. Equal windows have equal names."""
    return sliding_least(grams, window - length + 1, F.size(words) - (window - 1))


def _hashes(words: Column, length: int) -> Column:
    return F.transform(
        positions(F.size(words) - (length - 1)), lambda at: F.xxhash64(F.lit(length), *gram(words, at, length))
    )


def _named(rows: DataFrame, window: int, length: int, short: list[int]) -> DataFrame:
    """Add ``names``: array of (words of the window, its name by start) for the window lengths in use."""
    cut = rows.withColumn("grams", _hashes(F.col("words"), length))
    part = lambda size, names: F.struct(F.lit(size).alias("size"), names.alias("names"))
    parts = [part(window, _anchors(F.col("words"), F.col("grams"), window, length))]
    parts += [part(size, _hashes(F.col("words"), size)) for size in short]
    return cut.withColumn("names", F.array(*parts)).drop("grams")


def _spelled(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    length: int = GRAM,
    carry: list[str] | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Per row: ``_row``, n_words, n_hit, n_items, items_sha256, contaminated, items, hits (and ``_text``).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole texts, A-Z lowered. An item's windows are
    its runs of ``window`` consecutive words; an item of fewer words, but not none, is one window.
    A document word inside any occurrence of a window is hit. ``hits`` holds (start, size) of the
    occurrences, ``items`` the ids as text of items with one, sorted. Null texts have no words; a
    null item id counts as no item, but its windows hit. Repeated item rows change nothing.
    See ``keyed`` for null and repeated document ids.
    """
    if not 1 < length < window:
        raise ValueError("the gram must have 2 words at least and fewer than the window")
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    items = items.select("item", words_of(ascii_lower(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    sizes = items.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect()
    short = sorted(row["n"] for row in sizes)  # fewer than ``window`` values
    named = _named(items, window, length, short)
    # Outer explodes: for the others Spark infers a filter, pushes it below the projections and so
    # works the nested expressions out again for every element.
    own = named.select("item", "words", F.explode_outer("names").alias("part")).filter(
        (F.col("part.size") == window) | (F.size("words") == F.col("part.size"))
    )
    placed = own.select(
        "item", "words", F.col("part.size").alias("size"), F.posexplode_outer("part.names").alias("start", "name")
    ).filter(F.col("name").isNotNull())
    windows = staged(
        placed.select("item", "name", _spelled(F.col("words"), F.col("start"), F.col("size")).alias("window")).distinct(),
        "windows",
    )
    marks = staged(windows.select("name").distinct(), "marks")

    source = keyed(docs, id_col, text_col, carry)
    cut = source.texts().select("_key", words_of(ascii_lower(F.col("_text"))).alias("words"))
    marked = _named(cut, window, length, short)
    every = F.array_distinct(F.flatten(F.transform("names", lambda part: part["names"])))
    shared = marked.select("_key", F.explode_outer(every).alias("name")).join(marks, "name")
    shared = staged(shared.groupBy("_key").agg(F.collect_list("name").alias("shared")), "shared")

    text = ["_text"] if keep_text else []
    joined = source.rows.join(shared, "_key", "left").select(
        "_key", "_row", *text, "shared", words_of(ascii_lower(F.col("_text"))).alias("words")
    )
    counted = joined.withColumn("n_words", F.size("words").cast("long"))
    far = counted.filter(F.col("shared").isNull()).select("_key", "_row", *text, "n_words")
    near = _named(counted.filter(F.col("shared").isNotNull()), window, length, short)
    # Starts of the windows whose name a benchmark window has, with what they say.
    starts = F.flatten(
        F.transform(
            "names",
            lambda part: F.filter(
                F.transform(
                    part["names"],
                    lambda name, at: F.when(
                        F.array_contains("shared", name),
                        F.struct(
                            at.alias("start"),
                            part["size"].alias("size"),
                            _spelled(F.col("words"), at, part["size"]).alias("window"),
                        ),
                    ),
                ),
                lambda one: one.isNotNull(),
            ),
        )
    )
    near = near.withColumn("places", starts).select("_key", "_row", *text, "n_words", "places")
    empty = F.array().cast("array<struct<start:int,size:int,window:string>>").alias("places")
    whole = staged(near.unionByName(far.select("*", empty)), "places")
    found = whole.select("_key", F.explode("places").alias("place")).select("_key", "place.*")
    if not source.unique:
        found = found.distinct()
    hits = found.join(windows.select("item", "window"), "window")
    # One list per document: its length is bounded by the document's and the benchmark's.
    grouped = hits.groupBy("_key").agg(
        F.collect_set(F.struct("start", "size")).alias("hits"), F.collect_set("item").alias("items")
    )
    ends = lambda hit: hit["start"] + hit["size"]
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda at, hit: F.struct(
            F.greatest(at["end"], ends(hit)).alias("end"),
            (at["n"] + F.greatest(F.lit(0), ends(hit) - F.greatest(at["end"], hit["start"]))).alias("n"),
        ),
        lambda at: at["n"],
    )
    per_document = grouped.select(
        "_key", covered.alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("hits").alias("hits")
    )
    kept = whole.select("_key", "_row", *text, "n_words").join(per_document, "_key", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return kept.select(
        "_row",
        *text,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items_found.alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"),
    )
