import public_tokenizers
from samples import awkward, empty, prose

from elastrain.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
KNOWN, BYTE = token_counts.unigram(token_counts.load_pieces(PATH))


def brute(word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + size * BYTE, best[end - 1][1] - size)]
        ways += [(best[s][0] + KNOWN[word[s:end]], best[s][1] - 1) for s in range(end) if KNOWN.get(word[s:end]) is not None]
        best.append(max(ways))
    return -best[-1][1]


def test_shared_prefixes_change_nothing():
    words = sorted({w for t in prose(60) for w in token_counts.pre_tokens(t)} | {"▁", "▁🙂é", "▁" + "a" * 300, "▁the", "▁then", "▁there"})
    assert dict(token_counts.count_all(iter(words), KNOWN, BYTE)) == {w: brute(w) for w in words}


def test_table(spark, monkeypatch):
    df, rows = awkward(spark, prose(30))
    want = sorted(((i, sum(map(brute, token_counts.pre_tokens(t or ""))), len(token_counts.pre_tokens(t or ""))) for i, t in rows), key=str)
    got = token_counts.count_tokens(df, PATH).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_pretokens) for r in got), key=str) == want
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0
