import random
import re

from samples import awkward, empty, prose

from elastrain.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def test_phrases(spark):
    draw = random.Random(2)
    texts = prose(60, words=50, vocabulary=40)
    items = []
    for i in range(40):
        w = draw.choice(texts).split()
        at = draw.randrange(len(w))
        items.append((i, " ".join(w[at : at + draw.randint(1, 12)]).upper() if i % 3 else " ".join(prose(1, seed=i, vocabulary=40))))
    items += [(100, None), (101, "..."), (102, "the"), (103, texts[5]), (103, texts[5]), (104, "É"), (105, "a a a a a a a")]
    df, rows = awkward(spark, [*texts, "a a a a a a a a a a", "the cat, the dog; THE end", "é É"])
    bench = spark.createDataFrame([(i, t, 1, "k") for i, t in items], "item_id bigint, text string, pos int, phrase string")
    for width in (5, 13):
        got = decontaminate.contamination(df, bench, width=width).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == brute(rows, items, width)
        assert all(r.n_items == len(r.items) for r in got)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    nothing = decontaminate.contamination(df, bench.where("false"))
    assert [r for r in nothing.collect() if r.n_hit or r.n_items or r.n_near] == [] and nothing.count() == len(rows)


def test_near_phrases(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (2, "one two three four changed six seven eight nine ten")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(docs, bench).collect()}
    assert got[1] == (10, 0) and got[2][0] == 0


def test_native(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    out = decontaminate.contamination(df, bench)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "NestedLoop", "Cartesian"))
    assert out.where(decontaminate.is_contaminated()).count() == 1
