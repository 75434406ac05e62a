"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Corpus counts of the benchmark's terms choose the rarest terms of every benchmark window: two more than
words of it may differ, so wherever it occurs, exactly or nearly, two of them stand in place. Only
postings of these terms are stored (document, position, the words around). A posting is matched with
another of the terms at its offset, so lists are intersected where they are stored, and the candidates
are compared with the window word by word: exact phrases, or near ones by the number of equal words.

Before rows are multiplied or shuffled, terms pass a bitmap of fixed size (``sketch``), which a scalar
subquery hands to every task; it lets through all that matter and few others, and joins decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elastrain.llm.common import whole_text, write_table

WINDOW = 13
# One word in so many may differ in a near occurrence.
NEAR = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what stands between words, after A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLOTS = 1 << 19
# A missing id is this number until the end, so that joins and groups see it like any other.
MISSING = -(1 << 63)


def words_of(text: Column) -> Column:
    """Words of a text as an array; only A-Z are lowered."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def sketch(df: DataFrame, *keys: str) -> Column:
    """Bitmap of SLOTS bits over the hashes of the keys, as the value of a scalar subquery."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    words = df.select(slot.alias("slot")).distinct().groupBy(F.expr("slot div 64").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    )
    places = df.sparkSession.range(SLOTS // 64).withColumnRenamed("id", "i").join(words, "i", "left")
    cells = F.sort_array(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return places.agg(cells.alias("cells")).select(F.col("cells.bits")).scalar()


def may_hold(bitmap: Column, *keys: Column) -> Column:
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    return F.getbit(F.get(bitmap, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item_id, words, phrase, length) of every window of an item; a shorter item is one window."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), words_of(whole_text(items, text_col)).alias("all")).where("size(all) > 0")
    length = F.least(F.size("all"), F.lit(width))
    parts = F.transform(F.sequence(F.lit(1), F.size("all") - length + 1), lambda i: F.slice("all", i, length))
    return rows.select("item_id", F.explode(parts).alias("words")).select(
        "item_id", "words", F.array_join("words", " ").alias("phrase"), F.size("words").alias("length")
    ).distinct()


def corpus_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of the given terms in all documents, summed per task before they are shuffled."""
    found = docs.select(F.explode_outer(words_of(whole_text(docs, text_col))).alias("term")).where("term IS NOT NULL")
    return found.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, length, term, at, delta, other): pairs of rare terms of a window, the place of the rarer, the other relative to it.

    Every place where at most length // NEAR words differ has both terms of a pair. Words that no document
    has differ everywhere: they leave fewer others to differ, and a window with too many occurs nowhere. A
    window of one word is a pair with itself.
    """
    spots = windows.select("phrase", "length", "words").distinct().select("phrase", "length", F.posexplode("words").alias("at", "term"))
    seen = spots.join(counts, "term").groupBy("phrase", "length").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("rare"))
    spare = F.floor(F.col("length") / NEAR).cast("int") - (F.col("length") - F.size("rare"))
    taken = seen.withColumn("spare", spare).where("spare >= 0").select("phrase", "length", F.expr("slice(rare, 1, spare + 2)").alias("rare"))
    pair = lambda x, y: F.struct(x.term.alias("term"), x.at.alias("at"), (y.at - x.at).alias("delta"), y.term.alias("other"))
    both = F.transform("rare", lambda x: F.transform(F.filter("rare", lambda y: F.struct(y.n, y.at) > F.struct(x.n, x.at)), lambda y: pair(x, y)))
    alone = F.transform("rare", lambda x: pair(x, x))
    return taken.select("phrase", "length", F.inline(F.when(F.col("length") == 1, alone).otherwise(F.flatten(both))))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows with one id apart; a missing id (see contamination) and a null text have keys like any other."""
    return F.xxhash64(F.coalesce(doc_id.cast("bigint"), F.lit(MISSING)), F.coalesce(text.cast("string"), F.lit("")))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Written postings of ``terms``: doc_id, key, pos (from 1), term, around (the words at up to width - 1
    places on either side), lead (how many of these stand before). Every document also has a row of
    position 0, whose ``lead`` is its number of words.
    """
    bitmap = sketch(terms, "term")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole_text(docs, text_col).alias("text"))
    # The empty word in front stands for the document itself.
    split = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.concat(F.array(F.lit("")), words_of(F.col("text"))).alias("words"))
    spots = split.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "term"))
    spots = spots.where((F.col("pos") == 0) | may_hold(bitmap, F.col("term")))
    begin = F.greatest(F.col("pos") + 2 - width, F.lit(2))
    postings = spots.select(
        "doc_id", "key", "pos", "term",
        F.when(F.col("pos") > 0, F.slice("words", begin, 2 * width - 1)).alias("around"),
        F.when(F.col("pos") > 0, F.col("pos") + 1 - begin).otherwise(F.size("words") - 1).alias("lead"),
    )
    return write_table(postings.join(terms.union(terms.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi"), "index")


def find_windows(index: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, start, phrase, length, same): candidates with two anchors in place, and their equal words."""
    bitmap = sketch(places, "term", "delta", "other")
    beside = F.transform(
        F.sequence(F.lit(0), F.size("around") - 1),
        lambda i: F.struct((i - F.col("lead")).alias("delta"), F.get("around", i).alias("other")),
    )
    pairs = index.where("pos > 0").select("doc_id", "key", "pos", "term", "around", "lead", F.inline_outer(beside))
    pairs = pairs.where(may_hold(bitmap, F.col("term"), F.col("delta"), F.col("other")))
    met = pairs.join(places, ["term", "delta", "other"]).where("pos > at AND lead >= at")
    text = F.slice("around", F.col("lead") - F.col("at") + 1, F.col("length"))
    equal = F.zip_with(text, F.split("phrase", " "), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    return met.where(F.size(text) == F.col("length")).select(
        "doc_id", "key", (F.col("pos") - F.col("at")).alias("start"), "phrase", "length",
        F.aggregate(equal, F.lit(0), lambda s, x: s + x).alias("same"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurring window), n_items, items (their
    ids as sorted strings), n_near (places where a window occurs but for at most a fifth of its words, each word compared
    with the one in its place), key (``row_key`` of id and text).

    Null and empty texts have no words and no hits; items without words have no windows; an item that
    stands twice counts once. Rows that repeat are each returned. Empty tables give no rows or no hits.
    """
    missing = F.lit(MISSING)
    docs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), missing).alias("doc_id"), whole_text(docs, text_col).alias("text"))
    windows = write_table(windows_of(items, item_col, item_text_col, width), "windows")
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    counts = write_table(corpus_counts(docs, "text", vocabulary), "counts")
    places = write_table(anchors(windows, counts), "anchors")
    index = build_index(docs, places.select("term").distinct(), "doc_id", "text", width)
    found = write_table(find_windows(index, places, width).distinct(), "found")

    row = ["doc_id", "key"]
    exact, by_start = found.where("same = length"), Window.partitionBy(*row).orderBy("start")
    spans = exact.groupBy(*row, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    reach = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))
    hits = spans.select(*row, fresh.alias("fresh")).groupBy(*row).agg(F.sum("fresh").alias("n_hit"))
    which = exact.select(*row, "phrase").distinct().join(windows.select("phrase", "item_id"), "phrase")
    which = which.groupBy(*row).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = found.where((F.col("same") < F.col("length")) & (F.col("length") - F.col("same") <= F.floor(F.col("length") / NEAR)))
    near = near.select(*row, "start").distinct().groupBy(*row).agg(F.count("*").alias("n_near"))
    marks = hits.join(which, row, "full").join(near, row, "full")
    documents = index.where("pos = 0").select(*row, F.col("lead").cast("bigint").alias("n_words"))
    joined = documents.join(marks, row, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.when(F.col("doc_id") != missing, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"),
        items_.alias("items"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "key",
    )


def is_contaminated() -> Column:
    """The rule: any word hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
