import random
from itertools import combinations

import corpus_pipeline
from samples import prose
from test_simhash import brute_roots

from elastrain.llm import near_copies, simhash


def sets(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def alike(a, b):
    return 5 * len(sets(a) & sets(b)) >= 4 * len(sets(a) | sets(b))


def changed(words, n, draw):
    """The words with n of them replaced, at least five places apart."""
    out = list(words)
    for at in draw.sample(range(3, len(words) - 5, 6), n):
        out[at] = f"new{draw.random()}"
    return out


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)


def test_planted_copies_of_every_similarity_go(spark):
    draw = random.Random(7)
    rows, want = [], 0
    for i in range(120):
        base = [f"w{draw.randrange(5000)}" for _ in range(240)]
        copy = changed(base, 1 + i % 5, draw)  # similarity 0.81 to 0.96
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        assert 0.8 <= len(sets(rows[-1][1]) & sets(rows[-2][1])) / len(sets(rows[-1][1]) | sets(rows[-2][1])) <= 0.97
    rows += [(1000, " ".join(changed(rows[0][1].split(), 12, draw)))]
    assert not alike(rows[0][1], rows[-1][1])
    assert [i for i, _ in kept(spark, rows)] == sorted([*range(0, 240, 2), 1000], key=lambda i: str((i, dict(rows)[i])))


def test_groups_are_those_of_all_pairs(spark):
    draw = random.Random(8)
    base = [f"w{draw.randrange(3000)}" for _ in range(240)]
    rows = [(i, " ".join(changed(base, draw.randint(0, 4), draw))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate([*prose(40), None, "", " \t", "one two", "ONE  two", "one two three"])]
    texts = dict(rows)
    roots = brute_roots(texts, [(a, b) for a, b in combinations(texts, 2) if alike(texts[a], texts[b])])
    assert {i for i, _ in kept(spark, rows)} == set(roots.values())


def test_bands_agree_as_often_as_the_sets():
    draw = random.Random(9)
    same = total = 0
    for _ in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(240)]
        a, b = near_copies.shingles(" ".join(base).encode()), near_copies.shingles(" ".join(changed(base, 5, draw)).encode())
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        same += sum(x == y for x, y in zip(near_copies.bands(a), near_copies.bands(b))) - near_copies.BANDS * j**near_copies.ROWS
        total += near_copies.BANDS
    assert abs(same / total) < 0.08


def template(n, size=240, own=0.156, seed=10):
    """Texts that share all but ``own`` of their shingles, every pair at a similarity of about 0.73."""
    draw = random.Random(seed)
    base = [f"t{draw.randrange(10**6)}" for _ in range(size)]
    places = round(size * own / 5)
    return [" ".join(w if not (i % 6 == 0 and i // 6 in range(2, 2 + places)) else f"u{k}x{i}" for i, w in enumerate(base)) for k in range(n)]


def test_a_template_makes_no_pairs(spark, monkeypatch):
    """Texts that have too little in common are told apart without being compared in pairs."""
    counts, plain = {}, near_copies.similar
    for n in (100, 200):
        seen = []

        def counted(pairs, sets, similarity):
            seen.append(pairs.count())  # noqa: B023
            return plain(pairs, sets, similarity)

        monkeypatch.setattr(near_copies, "similar", counted)
        texts = template(n)
        assert 0.7 < len(sets(texts[0]) & sets(texts[1])) / len(sets(texts[0]) | sets(texts[1])) < 0.8
        assert len(kept(spark, list(enumerate(texts)))) == n
        counts[n] = sum(seen)
    assert counts[200] <= 2.2 * counts[100] and counts[200] < 40 * 200


def test_prefixes_lose_no_pair(spark):
    """Sets of many sizes around the similarity, all with components of their own."""
    draw = random.Random(12)
    rows = []
    for k in range(6):
        base = [draw.randrange(1000 * k, 1000 * k + 60) for _ in range(draw.randint(1, 40))]
        for _ in range(25):
            own = {x for x in base if draw.random() > 0.08} | {draw.randrange(10**6) for _ in range(draw.randint(0, 3))}
            rows.append((bytes([len(rows)]), own))
    for similarity in (0.8, 0.5):
        df = spark.createDataFrame([(i, i, sorted(s)) for i, s in rows if s], "node binary, root binary, found array<bigint>")
        found = near_copies.similar(near_copies.prefix_pairs(df, similarity), df, similarity)
        want = {(a, b) for (a, s), (b, t) in combinations([r for r in rows if r[1]], 2) if len(s & t) >= similarity * len(s | t)}
        assert want and {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in found.collect()} == want


def test_fingerprints_link_near_equal_texts_first(spark, monkeypatch):
    """What is compared first are the texts that SimHash links; MinHash bands only add to it."""
    draw = random.Random(14)
    bases = [[f"w{draw.randrange(5000)}" for _ in range(2000)] for _ in range(6)]
    rows = [(10 * i + k, " ".join(changed(b, k, draw))) for i, b in enumerate(bases) for k in (0, 1)]
    prints = {i: simhash.simhash(t.encode()) for i, t in rows}
    assert all(bin((prints[10 * i] ^ prints[10 * i + 1]) % 2**64).count("1") <= 3 for i in range(6))
    compared, plain = [], near_copies.similar

    def noted(pairs, sets, similarity):
        compared.append({(bytes(r.a), bytes(r.b)) for r in pairs.collect()})
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "similar", noted)
    assert [i for i, _ in kept(spark, rows)] == [0, 10, 20, 30, 40, 50]
    assert len(compared[0]) == 6 and not any(compared[1:])


def test_a_group_of_near_copies_leaves_few_pairs(spark, monkeypatch):
    """Copies with changes of their own are linked through the most usual of them, not in pairs."""
    draw = random.Random(15)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(changed(base, 1 + i % 5, draw))) for i in range(240)]
    compared, plain = [], near_copies.similar

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return plain(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "similar", counted)
    texts = dict(rows)
    roots = brute_roots(texts, [(a, b) for a, b in combinations(texts, 2) if alike(texts[a], texts[b])])
    assert {i for i, _ in kept(spark, rows)} == set(roots.values())
    assert compared[-1] < len(rows) / 4


def test_two_sets_meet_once(spark):
    draw = random.Random(16)
    base = list(range(100))
    sets = [(bytes([i]), bytes([i]), sorted({*draw.sample(base, 95), 1000 + i})) for i in range(40)]
    df = spark.createDataFrame(sets, "node binary, root binary, found array<bigint>")
    rooted = near_copies._rooted(near_copies.prefixes(df, 0.8), df.select("node", "root"))
    met = [tuple(sorted((bytes(r.node), bytes(r.other)))) for r in near_copies.first_meetings(rooted, 0.8).collect()]
    assert sorted(met) == sorted(combinations(sorted(bytes([i]) for i in range(40)), 2))
