import re
from collections import Counter, defaultdict

from pyspark.sql import Row
from samples import empty

from elastrain.llm.divergence import Stretch, _block_distances, audit, source_counts, stretch_terms


def brute(rows, min_df, top):
    texts, groups = defaultdict(list), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts[lang].append((source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)))
        groups.add((lang, source))
    out = []
    for lang, docs in texts.items():
        df = Counter(w for _, words in docs for w in set(words))
        kept = {w for w, n in df.items() if n >= min_df}
        counts = {s: Counter() for g, s in groups if g == lang}
        for source, words in docs:
            counts[source].update(w for w in words if w in kept)
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, w) - share(d, w)) for w in kept), t.encode(), t) for t, d in counts.items() if t != s]
            terms = [(share(whole, w) - share(c, w), w.encode(), w) for w in c if share(c, w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(n=160):
    import random

    draw, rows = random.Random(11), []
    pool = ["".join(draw.choice("abcdeÉß") for _ in range(draw.randint(1, 4))) for _ in range(60)]
    for i in range(n):
        lang = draw.choice(["en", "de", None, "", "x\0y"])
        words = [draw.choice(pool[: 20 + 40 * (i % 3 == 0)]).capitalize() for _ in range(draw.randint(0, 30))]
        rows.append((draw.choice([" ", ", ", "-", "\n"]).join(words), lang, draw.choice(["a", "a", "a", "b", "É", None])))
    rows += [(None, "en", "only nulls"), ("", "en", "b"), ("same words " * 20_000, "de", "a"), ("rare", "solo", "one"), ("rare", "solo", "two")]
    return rows + [rows[0]] * 3


def test_table(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, doc_id bigint, term string, n int")
    for min_df, top, block in ((4, 5, 200_000), (4, 1000, 7), (10_000, 5, 10)):
        got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in audit(df, min_df, top, block).collect())
        assert got == brute(rows, min_df, top)
    assert audit(empty(spark)).count() == 0


def test_large_counts(spark):
    from pyspark.sql import functions as F

    from elastrain.llm.divergence import share

    cases = [(0, 0, 1), (10**13, 10**15, 10**6), (5, 7, 3), (3 * 10**12, 3 * 10**12, 1)]
    got = spark.createDataFrame([Row(n=n, total=t, v=v) for n, t, v in cases]).select(share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r.p for r in got.collect()] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]


def test_source_without_terms_in_a_block():
    import numpy as np

    block = {"source_no": np.array([2, 5, 9, 5, 9, 9]), "term_no": np.array([-1, -1, -1, 4, 4, 8]), "p": np.array([10, 20, 30, 25, 36, 47])}
    got = {(int(a[i]), int(b[i])): int(v[i]) for a, b, v in _block_distances(block) for i in range(len(a))}
    assert got == {(2, 5): 15 + 10, (2, 9): 26 + 37, (5, 9): 11 + 27}


def test_stretches_of_any_length(spark):
    rows = [*rows_of(60), ("aB" * 700_000 + " x-y " + "\u00e9x " * 400_000, "de", "long"), ("\0\x7f 12", "en", "signs only")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for stretch in (1, 300, 10**7):
        got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in audit(df, 3, 50, stretch=stretch).collect())
        assert got == brute(rows, 3, 50)


def test_corpus_is_read_once_and_its_terms_are_listed_by_digits(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    rows = [("a b c " * 100 + "z" * i, "en", "s") for i in range(1, 65)]
    seen, fitted, fit = spark.sparkContext.accumulator(0), [], CountVectorizer.fit

    def counted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    def watched(self, df, params=None):
        fitted.append(df.select(F.explode("terms")).count())
        return fit(self, df, params)

    monkeypatch.setattr(CountVectorizer, "fit", watched)
    schema = "text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    counts, _ = source_counts(docs.mapInArrow(counted, schema), 30)
    assert sorted(r.n for r in counts.collect()) == [64 * 100] * 3
    assert seen.value == 64  # once for the fit and once to count, before
    assert fitted == [4]  # the terms kept and the filler; every term of every document, before
    listed = {r.source: r.n for r in stretch_terms(docs).groupBy("source").agg(F.sum(F.size("terms")).alias("n")).collect()}
    assert listed == {None: 64 + 3, "s": 64 + 3 * 3}  # 64 has one digit set and 6400 three


def test_stretch_ends_by_terms_bytes_vocabulary_and_documents():
    vocabulary = b" ".join(b"%c%c" % (97 + i // 26, 97 + i % 26) for i in range(125))
    for texts in ([b"a " * 1000], [b"a" * 8000], [vocabulary], [b"a"] * 31):
        stretch = Stretch()
        for text in texts:
            assert not stretch.full(1000)
            stretch.add(text, "en", "s")
        assert stretch.full(1000)
