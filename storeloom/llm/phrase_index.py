"""Benchmark texts found in documents through a distributed positional inverted index.

The index has a row per posting: term, document, position.  Every task writes the postings
of its own documents, sorted by term, so a frequent term is a long run in many files and
never one big list.  Searches read the lists of the rarest terms of each test text, shift
them by the terms' places in it and intersect them; only where those lists agree are the
lists of the other terms looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.llm.common import ascii_lower, body, saved

# Fixed value: what stands between words.  Letters of either case are kept: words are
# lower-cased one by one, which takes less than to lower-case and then to split.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Consecutive words of a test text that make a phrase.
WINDOW_WORDS = 10
# Lists of a phrase that are intersected before the others are looked at.
RAREST = 2
# A proximity match: so many of the text's rarest terms within so many words.
NEAR_TERMS, NEAR_WORDS = 4, 20
# The term of the index entry that says how many words a document has; no word is like it.
LENGTH = " "


def _pieces(text: Column) -> Column:
    """The words in their own case; the first and the last piece may be empty."""
    return F.split(body(text), BETWEEN, -1)


def _n_words(pieces: Column) -> Column:
    """How many pieces are words."""
    last = (F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")
    return F.size(pieces) - (F.get(pieces, F.lit(0)) == "").cast("int") - last.cast("int")


def row_key(row_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id, null or not, and its whole text."""
    shown = F.coalesce(row_id.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(shown, F.lit("|"), body(text))))


def _named(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.col(f"`{id_col}`"), F.col(f"`{text_col}`")


def test_words(tests: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each word of the test texts: ``item_id`` (a string), ``item``, ``n``, ``offset``, ``term``.

    ``item`` names a text; an id can have several, and texts without words have no rows.
    """
    row_id, text = _named(tests, id_col, text_col)
    words = tests.select(
        row_id.cast("string").alias("item_id"),
        row_key(row_id, text).alias("item"),
        F.filter(F.transform(_pieces(text), ascii_lower), lambda w: w != "").alias("w"),
    ).distinct()
    return words.select(
        "item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("offset", "term")
    )


@dataclass(frozen=True)
class PhraseIndex:
    """Postings (``term``, ``key``, ``pos``) of the terms of some test texts, and their counts.

    Positions count from the first word, or from one before where the document starts with
    something else.  The row with the term ``LENGTH`` has the document's id in ``doc_id``
    and its number of words in ``pos``.
    """

    postings: DataFrame
    counts: DataFrame
    tests: DataFrame

    @property
    def documents(self) -> DataFrame:
        """``key``, ``doc_id``, ``n_words``; rows that repeat stay."""
        own = self.postings.filter(F.col("term") == LENGTH)
        return own.select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))


def build_index(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> PhraseIndex:
    """The index of all documents for the terms that occur in ``tests``, written to the shared folder.

    A term of no test text takes part in no match, so its postings are not stored.  The
    documents are read once and nothing of them is shuffled where Spark finds the list of
    the tests' terms small enough to broadcast; else the words meet it by a join that
    splits frequent ones.
    """
    words = saved(test_words(tests, item_col, item_text_col), "phrase-tests")
    end = docs.sparkSession.createDataFrame([(LENGTH,)], "term string")
    terms = saved(words.select("term").union(end).distinct(), "phrase-terms")
    row_id, text = _named(docs, id_col, text_col)
    spread = docs.select(
        row_id.cast("long").alias("doc_id"), row_key(row_id, text).alias("key"), _pieces(text).alias("w")
    ).select(
        "doc_id",
        "key",
        _n_words(F.col("w")).alias("n_words"),
        F.posexplode(F.concat("w", F.array(F.lit(LENGTH)))).alias("pos", "word"),
    )
    own = F.col("term") == LENGTH
    postings = saved(
        spread.withColumn("term", ascii_lower(F.col("word")))
        .join(terms, "term")
        .select(
            "term",
            "key",
            F.when(own, F.col("n_words")).otherwise(F.col("pos")).alias("pos"),
            F.when(own, F.col("doc_id")).alias("doc_id"),
        )
        .sortWithinPartitions("term"),
        "phrase-index",
    )
    counts = saved(postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "phrase-counts")
    return PhraseIndex(postings, counts, words)


def _rarest_places(index: PhraseIndex, window: int, rarest: int) -> DataFrame:
    """The places of test texts whose lists are read first: the ``rarest`` of every phrase.

    A phrase with a term that no document has is left out.
    """
    size = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("offset") - F.col("size") + 1),
        F.least(F.col("offset"), F.col("n") - F.col("size")),
    )
    phrase = Window.partitionBy("item", "start")
    placed = (
        index.tests.join(index.counts, "term")
        .withColumn("size", size)
        .withColumn("start", F.explode(starts))
        .withColumns(
            {
                "found": F.count(F.lit(1)).over(phrase),
                "rank": F.row_number().over(phrase.orderBy("cf", "offset")),
            }
        )
    )
    chosen = placed.filter((F.col("found") == F.col("size")) & (F.col("rank") <= rarest))
    return chosen.select("item", "item_id", "n", "size", "offset", "term").distinct()


def phrase_matches(
    index: PhraseIndex, window: int = WINDOW_WORDS, rarest: int = RAREST
) -> DataFrame:
    """Where documents repeat phrases of test texts: ``key``, ``item_id``, ``item``,
    ``first`` and ``last`` position in the document, ``offset`` of the first in the text.

    A phrase is ``window`` consecutive words of a text, or the whole of a shorter one.  A row
    is a longest run of equal words; all phrases in it occur there.
    """
    places = saved(_rarest_places(index, window, rarest), "phrase-places")
    diagonal = ["item", "item_id", "key", "shift"]
    lists = index.postings.join(places, "term").select(
        "item", "item_id", "n", "size", "key", (F.col("pos") - F.col("offset")).alias("shift"), "offset"
    )
    agreed = saved(
        lists.groupBy(*diagonal, "n", "size")
        .agg(
            F.min("offset").alias("low"), F.max("offset").alias("high"), F.count(F.lit(1)).alias("met")
        )
        .filter(F.col("met") >= F.least(F.lit(rarest), F.col("size"))),
        "phrase-agreed",
    )
    around = F.sequence(
        F.greatest(F.lit(0), F.col("low") - F.col("size") + 1),
        F.least(F.col("n") - 1, F.col("high") + F.col("size") - 1),
    )
    wanted = (
        agreed.select(*diagonal, "size", F.explode(around).alias("offset"))
        .join(index.tests.select("item", "offset", "term"), ["item", "offset"])
        .withColumn("pos", F.col("shift") + F.col("offset"))
    )
    there = index.postings.join(agreed.select("key").distinct(), "key", "left_semi").select(
        "key", "term", "pos"
    )
    return (
        wanted.join(there, ["key", "term", "pos"])
        .groupBy(*diagonal, "size")
        .agg(F.sort_array(F.collect_set("offset")).alias("met"))
        .select(*diagonal, "size", F.posexplode("met").alias("nth", "offset"))
        .groupBy(*diagonal, "size", (F.col("offset") - F.col("nth")).alias("run"))
        .agg(F.min("offset").alias("offset"), F.max("offset").alias("upto"))
        .filter(F.col("upto") - F.col("offset") + 1 >= F.col("size"))
        .select(
            "key",
            "item_id",
            "item",
            (F.col("shift") + F.col("offset")).alias("first"),
            (F.col("shift") + F.col("upto")).alias("last"),
            "offset",
        )
    )


def proximity_matches(
    index: PhraseIndex, terms: int = NEAR_TERMS, within: int = NEAR_WORDS
) -> DataFrame:
    """Places where the rarest ``terms`` different terms of a text stand, in any order, within
    ``within`` words of a document: ``key``, ``item_id``, ``item``, ``last`` position.

    Of equally frequent terms the lesser counts as rarer; a text with fewer terms takes all.
    """
    rank = F.row_number().over(Window.partitionBy("item").orderBy("cf", "term"))
    chosen = (
        index.tests.select("item_id", "item", "term")
        .distinct()
        .join(index.counts, "term", "left")
        .fillna(0, ["cf"])
        .withColumn("rank", rank)
        .filter(F.col("rank") <= terms)
        .withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("item")))
    )
    along = Window.partitionBy("item", "key").orderBy("pos").rangeBetween(-(within - 1), 0)
    return (
        index.postings.join(saved(chosen.drop("cf"), "phrase-near"), "term")
        .withColumn("met", F.size(F.collect_set("rank").over(along)))
        .filter(F.col("met") == F.col("need"))
        .select("key", "item_id", "item", F.col("pos").alias("last"))
    )


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``item_ids``, ``near_item_ids``.

    ``n_hit`` counts the words inside any occurrence of a phrase of a test text, ``item_ids``
    has the texts found so, ``near_item_ids`` those with a proximity match, both sorted as strings.

    A null text has no words; rows that repeat are answered each; a null id stays null.  Test
    texts that share an id are one item, those without an id mark words but are no item, those
    without words match nothing.  Other columns, whatever their names, are not looked at.
    """
    index = build_index(docs, tests, id_col, text_col, item_col, item_text_col)
    runs = saved(phrase_matches(index, window), "phrase-runs")
    hits = (
        runs.select("key", F.explode(F.sequence("first", "last")).alias("pos"))
        .groupBy("key")
        .agg(F.count_distinct("pos").alias("n_hit"))
    )
    items = runs.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    near = (
        proximity_matches(index)
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("near_item_ids"))
    )
    none = F.array().cast("array<string>")
    found = hits.join(items, "key").join(near, "key", "full_outer")
    return index.documents.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("near_item_ids", none).alias("near_item_ids"),
    )
