"""Benchmark decontamination over a distributed positional inverted index.

Only DataFrame functions are used.

The index holds, for each term and document, the positions of the term.  A test
item's windows are searched by intersecting offset-adjusted lists from the
rarest terms: a window can only start at a place of a document if its rarest term
has a posting that gives this start and so has its next rarest.  Places that
survive are compared word by word; equal windows are looked for once, so a repetitive item
in a repetitive text costs as many comparisons as the text has words.
Lists of frequent terms are never read, so the index is built for the terms
that the queries ask for (or for all, if none are given).  The corpus is read
twice: for the frequencies of the items' terms, and for the postings together
with each document's number of words.

Proximity matches come from the same lists: all terms of a window, in any order,
within a number of consecutive words of a document.

Null or empty texts and items have no words.  Null ids are kept; an item with a
null id counts as found but is left out of the id list.  Rows that repeat a
``doc_id`` share that document's hits.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maploom.llm.tables import join_small, stored

#: What lies between words: they are digits, letters (A-Z too, before lower-casing) and all beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows (terms, windows, shifts) up to which the test side is broadcast.
BROADCAST_ROWS = 200_000
#: Words of a text that travel together where candidate places are looked at.
BLOCK_WORDS = 4096


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that to ASCII, and much faster."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; an empty array for null."""
    return _split(lowered(text))


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n`` (postings in the corpus) of each of ``terms``; 0 where a term never occurs."""
    seen = docs.select(F.explode(_split(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("term"))
    seen = join_small(seen, terms, "term", "left_semi", BROADCAST_ROWS).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def positional_index(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``term, doc_id, pos``: the postings of ``terms``, or of every term, and ``doc_id, n_words`` of each row.

    Written to the shared folder.  Rows with a null ``doc_id`` have no postings.
    """
    words = docs.select("doc_id", _split(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    # the empty term stands for the document itself
    each = words.select("doc_id", "n_words", F.posexplode(F.array_insert("words", 1, F.lit(""))).alias("pos", "w"))
    each = each.filter("doc_id is not null or pos = 0").select(lowered(F.col("w")).alias("term"), "doc_id", (F.col("pos") - 1).alias("pos"), F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"))
    if terms is not None:
        wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(""))).distinct()
        each = join_small(each, wanted, "term", "left_semi", BROADCAST_ROWS)
    index = stored(each, "postings")
    return index.filter("pos >= 0").select("term", "doc_id", "pos"), index.filter("pos < 0").select("doc_id", "n_words")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``item, words, n, len``: each item's words and its window length."""
    out = items.select("item", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    return out.withColumn("len", F.least(F.col("n"), F.lit(size)))


def anchors(windows: DataFrame, size: int, frequency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``window, words, len, t1, q1, t2, q2``; ``window, item``): the different windows of all items, each with its rarest and next rarest term and their places.

    Windows with a term that never occurs can't occur and are left out.
    """
    start = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len")))
    w = windows.select("item", "words", "len", start.alias("s")).select("item", "len", F.slice("words", F.col("s") + 1, F.col("len")).alias("words"))
    w = w.select("item", "len", "words", F.xxhash64("words").alias("window"))
    held = w.select("window", "item").distinct()
    each = w.select("window", "words", "len").distinct().select("*", F.posexplode("words").alias("q", "term")).join(frequency, "term")
    ranked = F.struct("frequency", "q", "term")
    r = each.groupBy("window", "words", "len").agg(F.sort_array(F.collect_list(ranked)).alias("r"))  # at most ``size`` terms each
    r = r.filter(F.col("r")[0]["frequency"] > 0)
    second = F.when(F.size("r") > 1, F.col("r")[1]).otherwise(F.col("r")[0])
    return r.select("window", "words", "len", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["q"].alias("q1"), second["term"].alias("t2"), second["q"].alias("q2")), held


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _items(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``item, text, item_ids``; ``item, words, n, len``; ``term, frequency``): equal texts are one item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    named = items.groupBy("text").agg(F.collect_set("item_id").alias("item_ids"))
    named = stored(named.filter("text is not null").select(F.xxhash64("text").alias("item"), "text", "item_ids"), "items")
    windows = stored(item_windows(named, size), "item-words")
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    return named, windows, stored(document_frequency(docs, vocabulary).withColumnRenamed("n", "frequency"), "frequency")


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, hits, item_ids``; ``doc_id, n_words``): the hit word positions and the items of documents with occurring windows, and every row's number of words."""
    docs = _plain(docs)
    named, windows, frequency = _items(docs, benchmark, size)
    keys, held = anchors(windows, size, frequency)
    keys = stored(keys, "anchors")
    index, counted = positional_index(docs, keys.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())

    def places(term: str, q: str) -> DataFrame:
        side = keys.select(F.col(term).alias("term"), "window", "len", F.col(q).alias("q"))
        found = join_small(index, side, "term", "inner", BROADCAST_ROWS)
        return found.select("doc_id", "window", "len", (F.col("pos") - F.col("q")).alias("start")).filter("start >= 0")

    on = ["doc_id", "window", "start"]
    block = F.expr(f"start div {BLOCK_WORDS}").alias("block")
    maybe = places("t1", "q1").join(places("t2", "q2").select(on), on, "left_semi").select(*on, "len", block).distinct()
    maybe = stored(maybe, "candidates")
    # only slices of a text travel on: first blocks of words, then the words at each candidate place
    texts = join_small(docs, maybe.select("doc_id").distinct(), "doc_id", "left_semi", BROADCAST_ROWS).select("doc_id", words_of(F.col("text")).alias("words"))
    first = F.sequence(F.lit(0), F.floor(F.size("words") / BLOCK_WORDS).cast("int"))
    texts = texts.select("doc_id", F.explode(F.transform(first, lambda b: F.struct(b.cast("long").alias("block"), F.slice("words", b * BLOCK_WORDS + 1, BLOCK_WORDS + size - 1).alias("part")))).alias("b")).select("doc_id", "b.*")
    at = maybe.groupBy("doc_id", "block").agg(F.collect_list(F.struct("window", "start", "len")).alias("at"))
    near = texts.join(at, ["doc_id", "block"])
    cut = F.transform("at", lambda a: F.struct(a["window"].alias("window"), a["start"].alias("start"), F.slice("part", (a["start"] - F.col("block") * BLOCK_WORDS + 1).cast("int"), a["len"]).alias("theirs")))
    near = near.select("doc_id", "block", F.explode(cut).alias("c")).select("doc_id", "block", "c.*")
    found = join_small(near, keys.select("window", "words"), "window", "inner", BROADCAST_ROWS).filter(F.col("theirs") == F.col("words"))
    found = stored(found.select("doc_id", "block", "window", "start", F.size("words").alias("len")), "occurrences")
    covered = F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
    hits = found.groupBy("doc_id", "block").agg(F.array_distinct(covered).alias("hits")).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    items = found.select("doc_id", "window").distinct().join(held, "window").select("doc_id", "item").distinct().join(named.select("item", "item_ids"), "item", "left")
    items = items.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return hits.join(items, "doc_id", "left"), counted


def near_items(docs: DataFrame, benchmark: DataFrame, size: int = 13, within: int = 20) -> DataFrame:
    """``doc_id, item_ids, n_windows``: proximity matches.

    A window matches a document if some ``within`` consecutive words of the document hold all of the
    window's different terms, in any order.  Candidates are places where the window's two rarest terms
    lie less than ``within`` apart, from their postings; the others are then looked up around them.
    ``n_windows``: matching windows of the item.  Null ids match nothing.
    """
    docs = _plain(docs).filter("doc_id is not null")
    named, windows, frequency = _items(docs, benchmark, size)
    w = windows.select("item", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("s"), "words", "len")
    w = w.select("item", "s", F.explode(F.array_distinct(F.slice("words", F.col("s") + 1, F.col("len")))).alias("term")).join(frequency, "term")
    w = w.groupBy("item", "s").agg(F.sort_array(F.collect_list(F.struct("frequency", "term"))).alias("r")).filter(F.col("r")[0]["frequency"] > 0)  # at most ``size`` terms each
    terms = F.transform("r", lambda t: t["term"])
    w = w.select("item", "s", terms.alias("terms")).withColumns({"t1": F.col("terms")[0], "t2": F.coalesce(F.get("terms", F.lit(1)), F.col("terms")[0])})
    w = stored(w, "near-windows")
    index, _ = positional_index(docs, w.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())

    def places(term: str) -> DataFrame:
        return join_small(index, w.select(F.col(term).alias("term"), "item", "s"), "term", "inner", BROADCAST_ROWS).select("doc_id", "item", "s", "pos")

    a, b = places("t1").alias("a"), places("t2").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "item", "s")]
    close = a.join(b, [*same, F.abs(F.col("a.pos") - F.col("b.pos")) < within], "left_semi")
    texts = join_small(docs, stored(close.select("doc_id").distinct(), "near-documents"), "doc_id", "left_semi", BROADCAST_ROWS)
    each = close.join(w.select("item", "s", "terms"), ["item", "s"]).join(texts.select("doc_id", words_of(F.col("text")).alias("theirs")), "doc_id")
    low = F.greatest(F.col("pos") - within + 1, F.lit(0))
    around = F.slice("theirs", low + 1, F.col("pos") - low + within)
    each = each.select("doc_id", "item", "s", "terms", around.alias("around"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("around") - within + 1, F.lit(1)))
    each = each.filter(F.exists(starts, lambda i: F.size(F.array_except("terms", F.slice("around", i, within))) == 0))
    each = join_small(each.select("doc_id", "item", "s").distinct(), named.select("item", "item_ids"), "item", "inner", BROADCAST_ROWS)
    return each.groupBy("doc_id", "item").agg(F.first("item_ids").alias("item_ids"), F.count(F.lit(1)).alias("n_windows")).drop("item")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for every document.

    A document is contaminated if at least one in ``share`` of its words is hit.
    """
    found, counted = find_items(docs, benchmark, size)
    out = join_small(counted, stored(found, "found"), "doc_id", "left", BROADCAST_ROWS)
    hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
