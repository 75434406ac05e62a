import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from samples import awkward, empty, prose

from elastrain.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.vocabulary(f.read())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary[0], special_tokens={})


def test_encodes_as_the_library(vocabulary, library):
    draw = random.Random(5)
    chars = "  \n\t'''’stmdrevlaé1٣ 　.,!中-\0🙂\x85\x1c"
    texts = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 60))) for _ in range(5000)]
    texts += ["", "'s", "don't'll've x's 're''s", "a" * 5000, " " * 300 + "x", "x" + "\n" * 300, "the " * 3000]
    ids, counts = bpe.encode_texts(texts, bpe.Merges(vocabulary[0]))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == library.encode_ordinary(text)


def test_scan_composes_functions():
    of_class, table, values = bpe.functions()
    draw = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 20_000):
        f = of_class[draw.integers(0, bpe.END + 1, n)]
        state, states = bpe.FRESH, []
        for x in f:
            state = values[x, state]
            states.append(state)
        assert values[bpe.scan(f), bpe.FRESH].tolist() == states
    assert len(table) < 50


def test_long_pre_tokens_merge_alike(vocabulary):
    for word in (b"ab" * 60, b"tokenization" * 12, bytes(range(1, 200))):
        short, bpe.SHORT = bpe.SHORT, 1 << 30
        slow = bpe.merge(word, vocabulary[0])
        bpe.SHORT = short
        assert slow == bpe.merge(word, vocabulary[0])


def test_table_round_trip(spark, library):
    df, rows = awkward(spark, prose(30))
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)
    for r in got:
        for a, b in zip(r.starts, r.starts[1:] + [len(r.decoded)]):
            assert b > a
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0


def test_batches_are_cut_by_tokens_without_loss(monkeypatch):
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 5)
    lists = [[1, 2, 3], [], [4], [5] * 12, [], [6, 7], [8, 9, 10, 11, 12]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    parts = list(bpe._by_tokens([batch, batch.slice(2, 3), batch.slice(0, 0)]))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists + lists[2:5]
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 5 for p in parts)
