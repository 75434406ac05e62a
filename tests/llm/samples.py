"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random


def awkward(spark, texts, long_text="lorem ipsum " * 4000):
    """doc_id, text and columns named like the operators' own, for given texts and the awkward ones."""
    rows = [(i, t) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, long_text), (n + 3, " \t\n"), (n + 4, texts[0]), (n + 5, "é🙂 中文 'S 's"), (n + 6, None)]
    rows += [(3, texts[3]), (3, texts[3])]  # repeated rows
    rows += [(None, "a row without an id"), (None, texts[1])]
    schema = "doc_id bigint, text string, n bigint, spans string, key string, fp double, score string, kept int, `odd name` string"
    return spark.createDataFrame([(i, t, 1, None, "k", 0.5, "s", 0, None) for i, t in rows], schema), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def prose(n, seed=1, words=40, vocabulary=120):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(draw.choice(pool) for _ in range(draw.randint(1, words))) for _ in range(n)]
