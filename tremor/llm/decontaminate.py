"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings ``row, doc_id, pos, n_words, term`` in the shared folder: every
occurrence, in the training documents, of a term that some test item uses (no other can take
part in a match), and for each document one row without a term.  A phrase is found by
intersecting posting lists, each moved back by the term's offset.  For each window of an item
the lists of its two rarest terms come first; what they agree on is an alignment (document,
item, shift), and only alignments meet the lists of the item's other terms.  Positions that
match without a gap form runs, and a run as long as a window is a match.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z in lower case; a window is ten
of an item's words, or all of a shorter item.  Null texts have no words.  Rows that repeat a
doc_id, and rows whose doc_id is null, are each looked at by themselves.  Items that share an
item_id count once; items whose item_id or text is null are left out.  Empty tables give no
rows or no matches; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import BROADCAST_ROWS, written

WINDOW = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of a written table if it has few rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= bound else df


def folded(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def word_rows(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each word (``pos`` from 0), and for a text without words one row whose word is empty; ``n_words`` beside them."""
    split = df.select(*keep, F.split(F.coalesce("text", F.lit("")), _BETWEEN).alias("w"))
    lead = (F.col("w")[0] == "").cast("int")
    tail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    counted = split.select(*keep, "w", lead.alias("lead"), (F.size("w") - lead - tail).cast("long").alias("n_words"))
    return counted.select(*keep, "lead", "n_words", F.posexplode("w").alias("at", "word")).select(
        *keep, "n_words", (F.col("at") - F.col("lead")).alias("pos"), "at", folded(F.col("word")).alias("word"))


@dataclass(frozen=True)
class Items:
    """Test items: ``item, item_id, pos, n_words, term`` for each word, and ``word, term`` for each distinct word."""

    words: DataFrame
    terms: DataFrame


def items(benchmark: DataFrame) -> Items:
    listed = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    rows = written(word_rows(listed, "item", "item_id").filter("word <> ''").drop("at"), "items")
    terms = written(rows.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    return Items(written(rows.join(terms, "word").drop("word"), "item-terms"), terms)


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Write the postings, in document order, and read them back."""
    every = word_rows(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "row", "doc_id")
    found = every.join(small(terms), "word", "left").filter("term is not null or at = 0")
    return written(found.select("row", "doc_id", "n_words", "pos", "term"), "postings")


def _windows(words: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """``item, w, offset, term, n`` for each place of each window whose terms all occur, ``n`` being the term's postings."""
    counts = postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    length = F.least(F.col("n_words"), F.lit(window))
    first = F.greatest(F.lit(0), F.col("pos") - length + 1)
    last = F.least(F.col("pos"), F.col("n_words") - length)
    places = words.join(counts, "term", "left").withColumn("w", F.explode(F.sequence(first, last)))
    whole = Window.partitionBy("item", "w")
    return places.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(whole)).filter("least > 0").select(
        "item", "w", (F.col("pos") - F.col("w")).alias("offset"), "pos", "term", "n", length.alias("length"))


def rarest(words: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """The two rarest places of every window that can occur (of one, if it has one word)."""
    order = Window.partitionBy("item", "w").orderBy("n", "offset")
    return _windows(words, postings, window).withColumn("k", F.row_number().over(order)).filter("k <= 2")


def alignments(words: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """``row, item, shift``: where the two rarest terms of some window stand as in the item."""
    pair = written(rarest(words, postings, window).select("item", "w", "pos", "term", "length"), "rarest")
    met = postings.filter("term is not null").select("row", F.col("pos").alias("at"), "term").join(small(pair), "term").select(
        "row", "item", "w", (F.col("at") - F.col("pos")).alias("shift"), F.least("length", F.lit(2)).alias("need"))
    agreed = met.groupBy("row", "item", "w", "shift").agg(F.count("*").alias("k"), F.first("need").alias("need")).filter("k = need")
    return agreed.select("row", "item", "shift").distinct()


def runs(words: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, item_id, start, length``: the longest stretches of document words that are an item's, word by word."""
    found = written(alignments(words, postings, window), "alignments")
    wanted = found.join(words, "item").select("row", "item", "item_id", "n_words", "shift", F.col("pos").alias("j"),
                                              (F.col("pos") + F.col("shift")).alias("pos"), "term")
    rows = small(written(found.select("row").distinct(), "aligned"))
    lists = postings.filter("term is not null").select("row", "pos", "term").join(rows, "row", "left_semi")
    met = wanted.join(lists, ["row", "pos", "term"])
    order = Window.partitionBy("row", "item", "shift").orderBy("j")
    stretch = met.withColumn("stretch", F.col("j") - F.row_number().over(order)).groupBy("row", "item", "item_id", "shift", "stretch", "n_words").agg(
        F.min("pos").alias("start"), F.count("*").alias("length"))
    return stretch.filter(F.col("length") >= F.least(F.col("n_words"), F.lit(window))).select("row", "item_id", "start", "length")


def near(words: DataFrame, postings: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """Proximity matches ``row, doc_id, item_id, start``: all of a window's terms, in any order, within ``slop`` words around its place.

    The place is where the window's rarest term puts it; ``start`` is the first word of that place.
    """
    places = written(_windows(words, postings, window).join(words.select("item", "item_id").distinct(), "item"), "windows")
    order = Window.partitionBy("item", "w").orderBy("n", "offset")
    lead = places.withColumn("k", F.row_number().over(order)).filter("k = 1")
    lists = postings.filter("term is not null")
    at = lists.select("row", "doc_id", F.col("pos").alias("p"), "term").join(lead, "term").select(
        "row", "doc_id", "item", "item_id", "w", (F.col("p") - F.col("offset")).alias("start"))
    need = places.groupBy("item", "w").agg(F.countDistinct("term").alias("need"))
    wanted = at.join(places.select("item", "w", "term", "length").distinct(), ["item", "w"])
    met = wanted.join(lists.select("row", "pos", "term"), ["row", "term"]).filter(
        (F.col("pos") >= F.col("start") - slop) & (F.col("pos") < F.col("start") + F.col("length") + slop))
    return met.groupBy("row", "doc_id", "item", "item_id", "w", "start").agg(F.countDistinct("term").alias("k")).join(need, ["item", "w"]).filter(
        "k = need").select("row", "doc_id", "item_id", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    tests = items(benchmark)
    postings = index(docs, tests.terms)
    matches = written(runs(tests.words, postings, window), "matches")
    hit = matches.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(
        F.count("*").alias("n_hit"))
    named = matches.select("row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("row").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("i")), ",").alias("names"))
    every = postings.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    none = F.lit(0).cast("long")
    return every.join(hit, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))
