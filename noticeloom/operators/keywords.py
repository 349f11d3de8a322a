"""Which keywords of a table stand in which texts: a join of many patterns with many texts.

Texts are dealt by their ids into chunks of a bounded size, keywords by hash into blocks of a bounded size,
and every chunk meets every block in one task. The task builds an automaton of its block and reads each text
of its chunk once, so what is written is the texts once a block, the keywords once a chunk and the hits once;
no letters or grams of a text become rows. Neither side passes the driver.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom.session import staged

#: Keywords and letters of a block; an automaton of that many takes up to 150 MB.
BLOCK_WORDS, BLOCK_LETTERS = 1 << 18, 1 << 21
#: Most bytes of the texts of a chunk. Few texts are dealt finer, down to the least, so that all cores have some.
CHUNK_BYTES, LEAST_BYTES = 32 << 20, 1 << 20


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, word in enumerate(words):
        if word:
            automaton.add_word(word, number)
    automaton.make_automaton()
    return automaton


def _places(texts: pa.ChunkedArray, words: list[str]) -> Iterator[list[int]]:
    """Ascending numbers of the words that stand in each text."""
    automaton = _automaton(words)
    always = {0} if words[0] == "" else set()
    for text in texts:
        found = {number for _, number in automaton.iter(text.as_py())} if len(automaton) else set()
        yield sorted(found | always)


def _searched(ids: Sequence[str]):
    """Texts of a chunk with the words of a block that they hold, sorted."""

    def search(texts: pa.Table, keywords: pa.Table) -> pa.Table:
        schema = pa.schema([*(texts.schema.field(name) for name in ids), ("hits", pa.list_(pa.string()))])
        if not texts.num_rows or not keywords.num_rows:
            return schema.empty_table()
        words = sorted(keywords["_word"].to_pylist())
        # Plain numbers, as a chunk of short titles has millions of texts.
        offsets, numbers = array("i", [0]), array("i")
        for found in _places(texts["_text"], words):
            numbers.extend(found)
            offsets.append(len(numbers))
        hits = pa.array(words, pa.string()).take(pa.array(np.asarray(numbers)))
        listed = pa.ListArray.from_arrays(pa.array(np.asarray(offsets)), hits)
        whole = pa.Table.from_arrays([*(texts[name] for name in ids), listed], schema=schema)
        return whole.filter(pc.greater(pc.list_value_length(listed), 0))

    return search


def _pieces(total: int, most: int) -> int:
    return max(1, -(-total // most))


def keyword_links(
    texts: DataFrame, keywords: DataFrame, ids: Sequence[str], text: str = "text", word: str = "text"
) -> DataFrame:
    """(ids, hits): the sorted distinct keywords that stand in a text, for texts that have any.

    ``ids`` identify a text and are not null. Case counts. A null text or keyword matches nothing, an
    empty keyword stands in every text. Both tables may be of any size; ``texts`` is read twice.
    """
    spark = texts.sparkSession
    rows = texts.select(*ids, F.col(text).alias("_text")).filter("_text is not null")
    words = staged(keywords.select(F.col(word).alias("_word")).filter("_word is not null").distinct(), "keywords")
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("_word")), F.lit(0)).alias("letters")).first()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(_pieces(size["n"], BLOCK_WORDS), _pieces(size["letters"], BLOCK_LETTERS))
    least = min(_pieces(total, LEAST_BYTES), 3 * spark.sparkContext.defaultParallelism)
    chunks = max(_pieces(total, CHUNK_BYTES), least)

    def dealt(columns: Sequence[str], pieces: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(pieces)).cast("int")

    def every(pieces: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))

    left = rows.select("*", dealt(ids, chunks).alias("_chunk"), every(blocks).alias("_block"))
    right = words.select("_word", dealt(["_word"], blocks).alias("_block"), every(chunks).alias("_chunk"))
    kept = T.StructType([*(rows.schema[name] for name in ids), T.StructField("hits", T.ArrayType(T.StringType()))])
    cells = [side.groupBy("_chunk", "_block") for side in (left, right)]
    found = cells[0].cogroup(cells[1]).applyInArrow(_searched(list(ids)), kept)
    if blocks == 1:
        return found
    return found.groupBy(*ids).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
