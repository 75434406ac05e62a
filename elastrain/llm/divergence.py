"""How far the sources of a language differ in their words, in exact integers.

The corpus is read once, in stretches of documents. Every term carries the language of its document, so the minimum
document frequency holds, and the vocabulary is, per language, however many languages there are. A stretch lists
each of its terms a few times instead of at every occurrence: by the binary digits of the number of its documents
with the term, and of its occurrences in each source. Spark sums the former, CountVectorizer is fitted on the terms
that enough documents have, and turns the lists of the sources into sparse vectors, which are summed by
(language, source), weighted by digit, as (term, count) entries. The entries of a language are cut into blocks of
terms; a block holds the sparse rows of all sources, and the distance of two of them is taken from their entries
alone, since all terms that a source lacks have one and the same share in it.

CountVectorizer keeps its vocabulary (the terms in at least ``min_df`` documents) on the driver and in every
executor; this is the one thing here that is not split.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.functions.arrow import groups_of
from elastrain.llm.common import arrow_map, column, whole_text, write_table

MIN_DF, TOP, SCALE, SMOOTH = 30, 50, 10**9, 5
MAX_VOCABULARY = 2**31 - 1
#: A-Z in lower case, every other ASCII byte that no term has a space; bytes of longer characters stay.
LOWERED = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Between language and term; no term holds it.
MARK = "\0"
BLOCK_ENTRIES = 200_000
#: Terms of a stretch and of a row of it; bytes of a text that are cut, and of terms that leave, at once.
STRETCH, ROW_TERMS, BYTES_AT_ONCE = 4_000_000, 50_000, 1 << 20
#: What a document takes in a stretch beside its terms, in terms.
DOC_COST = 32


class Stretch:
    """Documents of a task in a row: the numbers of their terms by language and source, and by language once a document."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.of_source: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        self.of_lang: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = self.bytes = self.docs = 0

    def full(self, most: int) -> bool:
        """After ``most`` terms, or sooner if these are long, mostly different or of very short documents."""
        return max(self.size + DOC_COST * self.docs, self.bytes // 8, 8 * len(self.terms)) >= most

    def add(self, text: bytes, lang: str, source: str) -> None:
        """A document, however long, is in one stretch; its terms are cut out a piece of text at a time."""
        letters, at, pieces = text.translate(LOWERED), 0, []
        while at < len(letters):
            end = letters.find(b" ", at + BYTES_AT_ONCE)
            end = len(letters) if end < 0 else end
            words = letters[at:end].split()
            pieces.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
            at = end
        if pieces:
            numbers = np.sort(np.concatenate(pieces))
            self.bytes += len(letters)
            self.of_source[lang, source].append(numbers)
            self.of_lang[lang].append(numbers[np.flatnonzero(np.diff(numbers, prepend=-1))])
            self.size += len(numbers)
            self.docs += 1

    def rows(self) -> Iterator[tuple[str, str | None, int, np.ndarray]]:
        """(lang, source, weight, numbers of terms): how often terms occur in a source, and with no source in how many
        documents of the language; a row is a binary digit of these counts, and its weight that of the digit.
        """
        found = [((lang, None), pieces) for lang, pieces in self.of_lang.items()]
        for (lang, source), pieces in [*found, *self.of_source.items()]:
            terms, n = _counted(np.concatenate(pieces), len(self.terms))
            for digit in range(int(n.max(initial=0)).bit_length()):
                yield lang, source, 1 << digit, terms[(n >> digit) & 1 == 1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        lengths = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        waiting, size = [], 0
        for lang, source, weight, numbers in self.rows():
            for at in range(0, len(numbers), ROW_TERMS):
                waiting.append((lang, source, weight, numbers[at : at + ROW_TERMS]))
                size += int((lengths[waiting[-1][3]] + len(lang)).sum())
                if size >= BYTES_AT_ONCE:
                    yield _batch(waiting, words)
                    waiting, size = [], 0
        if waiting:
            yield _batch(waiting, words)


def _batch(rows: list[tuple[str, str | None, int, np.ndarray]], words: pa.Array) -> pa.RecordBatch:
    langs, sources, weights, numbers = zip(*rows)
    sizes = [len(n) for n in numbers]
    lang = pa.array(langs, pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
    led = pc.binary_join_element_wise(lang, words.take(pa.array(np.concatenate(numbers))), pa.scalar(MARK))
    terms = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), led)
    arrays = [pa.array(sources, pa.string()), pa.array(weights, pa.int64()), terms]
    return pa.RecordBatch.from_arrays(arrays, names=["source", "weight", "terms"])


def _counted(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (below ``most``) and how often each is there; few numbers are sorted, many are counted in place."""
    if 16 * len(numbers) < most:
        return np.unique(numbers, return_counts=True)
    n = np.bincount(numbers, minlength=most)
    found = np.flatnonzero(n)
    return found, n[found]


def stretch_terms(docs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """source, weight and terms (each led by its language and MARK) for stretches of about ``stretch`` terms.

    The corpus is read here, once. See Stretch.rows for what the rows mean.
    """

    def of_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = Stretch()
        for part in parts:
            for text, lang, source in zip(*[column(part, name) for name in ("text", "lang", "source")]):
                current.add(text, lang, source)
                if current.full(stretch):
                    yield from current.batches()
                    current = Stretch()
        yield from current.batches()

    text = F.make_valid_utf8(whole_text(docs, "text")).cast("binary").alias("text")
    rows = docs.select(text, whole_text(docs, "lang").alias("lang"), whole_text(docs, "source").alias("source"))
    return arrow_map(rows, of_task, "source string, weight bigint, terms array<string>")


def source_counts(docs: DataFrame, min_df: int = MIN_DF, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term_no, n) for the kept terms that occur, and the vocabulary (term_no, lang, term).

    The fit reads the terms that ``min_df`` documents have, once; the transform reads the rows of all stretches.
    """
    spark = docs.sparkSession
    rows = write_table(stretch_terms(docs, stretch), "stretch-terms")
    of_docs = rows.where("source IS NULL").select("weight", F.explode("terms").alias("term"))
    kept = write_table(of_docs.groupBy("term").agg(F.sum("weight").alias("docs")).where(F.col("docs") >= min_df), "kept-terms")
    # A term that no language has keeps the vocabulary from being empty, which CountVectorizer refuses.
    filler = spark.range(1).select(F.array(F.lit("")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", vocabSize=MAX_VOCABULARY)
    model = counter.fit(kept.select(F.array("term").alias("terms")).unionAll(filler))
    words = [(i, *word.rsplit(MARK, 1)) for i, word in enumerate(model.vocabulary) if word]
    vocabulary = write_table(spark.createDataFrame(words, "term_no int, lang string, term string"), "vocabulary")
    vector = model.transform(rows.where("source IS NOT NULL")).select("source", "weight", F.unwrap_udt("vector").alias("v"))
    entry = F.explode(F.arrays_zip("v.indices", "v.values")).alias("e")
    n = (F.col("e.values").cast("bigint") * F.col("weight")).alias("n")
    entries = vector.select("source", "weight", entry).select("source", F.col("e.indices").alias("term_no"), n)
    # A term has one language, so language need not be part of the key.
    counts = entries.groupBy("source", "term_no").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "source-counts")
    return counts.join(vocabulary.select("term_no", "lang"), "term_no").select("lang", "source", "term_no", "n"), vocabulary


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact in decimals."""
    up = (n.cast("decimal(20,0)") + SMOOTH) * F.lit(SCALE)
    return F.call_function("div", up, total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * SMOOTH) + 1


def _block_distances(block: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, sum of |p_a - p_b| over the block's terms) for the sources a < b, one a at a time.

    Rows with term_no -1 give the share that a source has of every term it lacks.
    """
    heads = block["term_no"] < 0
    names, absent = block["source_no"][heads], block["p"][heads].astype(np.int64)
    order = np.argsort(names)
    names, absent = names[order], absent[order]
    who = np.searchsorted(names, block["source_no"][~heads])
    order = np.argsort(who, kind="stable")
    who, p = who[order], block["p"][~heads][order].astype(np.int64)
    terms, at = np.unique(block["term_no"][~heads][order], return_inverse=True)
    ends = np.searchsorted(who, np.arange(len(names) + 1))
    for a in range(len(names) - 1):
        mine = slice(ends[a], ends[a + 1])
        row = np.full(len(terms), absent[a])
        row[at[mine]] = p[mine]
        # Against sources that lack a term: from this row's values in order and their running sums.
        ordered = np.sort(p[mine])
        sums = np.concatenate([[0], np.cumsum(ordered)])
        below = np.searchsorted(ordered, absent)
        far = absent * below - sums[below] + (sums[-1] - sums[below]) - absent * (len(ordered) - below)
        far = far + (len(terms) - len(ordered)) * np.abs(absent - absent[a])
        # Corrected where the other source has the term.
        seen = row[at]
        more = np.concatenate([[0], np.cumsum(np.abs(seen - p) - np.abs(seen - absent[who]))])
        far = far + more[ends[1:]] - more[ends[:-1]]
        yield np.full(len(names) - a - 1, names[a]), names[a + 1 :], far[a + 1 :]


def _distances(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in groups_of(parts, ("lang", "block")):
        for a, b, far in _block_distances(block):
            arrays = [pa.array([block["lang"][0]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "a", "b", "value"])


def audit(
    docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, block_entries: int = BLOCK_ENTRIES, stretch: int = STRETCH
) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others and from its language.

    Part ``pair`` has every other source of the language and the summed difference of shares over all its kept
    terms; part ``term`` the ``top`` terms whose share in the source exceeds that in the language most.
    Null text, lang and source count as ''. A (lang, source) without terms is compared like any other (all its
    shares are equal); a language without kept terms has pairs of value 0; an empty table gives no rows.
    Repeated rows count each time; ids and other columns are not read.
    """
    counts, vocabulary = source_counts(docs, min_df, stretch)
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    found = docs.select(whole_text(docs, "lang").alias("lang"), whole_text(docs, "source").alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).alias("source_no")
    groups = found.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "terms"])
    groups = write_table(groups.select("lang", "source", "total", "terms", number), "sources")

    with_terms = groups.where("terms > 0")
    of_group = counts.join(with_terms, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    shares = of_group.select("lang", "source", "source_no", "term_no", "n", p)
    blocks = counts.groupBy("lang").agg(F.ceil(F.count("*") / block_entries).alias("blocks"))
    entries = shares.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term_no"), F.col("blocks")).alias("block"), "source_no", "term_no", "p")
    each_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    absent = share(F.lit(0), F.col("total"), F.col("terms")).alias("p")
    heads = with_terms.join(blocks, "lang").select("lang", each_block, "source_no", F.lit(-1).alias("term_no"), absent)
    dealt = entries.unionByName(heads).repartition("lang", "block").sortWithinPartitions("lang", "block")
    summed = arrow_map(dealt, _distances, "lang string, a int, b int, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    left = groups.select("lang", "source", F.col("source_no").alias("one"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("other"))
    pairs = left.join(right, "lang").where("one != other").withColumn("a", F.least("one", "other")).withColumn("b", F.greatest("one", "other"))
    pairs = pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    of_lang = counts.groupBy("lang", "term_no").agg(F.sum("n").alias("n"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    q = share(F.col("n"), F.col("total"), F.col("terms")).alias("q")
    above = shares.join(of_lang.join(lang_totals, "lang").select("term_no", q), "term_no").where("p > q")
    named = above.join(vocabulary.select("term_no", "term"), "term_no")
    marked = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(marked.withColumn("rank", rank).where(F.col("rank") <= top))
