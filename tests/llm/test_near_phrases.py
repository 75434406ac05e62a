import random

from test_decontaminate import decontaminate


def near_places(text, items, width=13):
    words, places = text.split(), set()
    for item in items:
        item = item.split()
        n = min(width, len(item))
        for i in range(len(item) - n + 1):
            for s in range(len(words) - n + 1):
                same = sum(a == b for a, b in zip(words[s : s + n], item[i : i + n]))
                if n - n // 5 <= same < n:
                    places.add(s)
    return len(places)


def test_near_places_are_those_of_all_comparisons(spark):
    draw = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    items = [" ".join(draw.choice(pool) for _ in range(n)) for n in (1, 2, 4, 5, 7, 9, 10, 12, 13, 13, 20, 30)]
    items += ["one two three four five six seven eight nine ten", "never seen here w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "unseen w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"]
    texts = ["one two three four changed six seven eight nine ten", "x w1 w2 w3 w4 w5 w6 y w8 w9 w10 w11 w12", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"]
    for _ in range(150):
        words = draw.choice(items).split()
        for at in draw.sample(range(len(words)), min(len(words), draw.randint(0, 3))):
            words[at] = draw.choice(["rare", *pool])
        texts.append(" ".join([draw.choice(pool) for _ in range(draw.randint(0, 3))] + words + [draw.choice(pool) for _ in range(draw.randint(0, 3))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r.n_near for r in decontaminate.contamination(docs, bench).collect()}
    want = {i: near_places(t, items) for i, t in enumerate(texts)}
    assert got == want and got[0] == 1 and sum(want.values()) > 50
