import random
import re
from itertools import combinations

import xxhash
from samples import awkward, empty, prose

from elastrain.llm.common import write_table
from elastrain.llm.components import smallest_reachable
from elastrain.llm.simhash import hamming_links, near_duplicates, simhash


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_fingerprints():
    texts = ["", " ", "One", "one TWO", "É e É", "a\x85b c d", *prose(100), "x y z " * 50_000]
    for t in texts[:-1]:
        assert simhash(t.encode()) % (1 << 64) == brute_print(t)
    assert simhash(texts[-1].encode()) == simhash(("x y z " * 49_999 + "x y z").encode())


def test_links_lose_none(spark):
    draw = random.Random(8)
    prints = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = draw.getrandbits(64)
        prints |= {x, *(x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(4))}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed * 2], "fp bigint")
    for radius, segments in ((3, 2), (3, 4), (2, 1)):
        want = {tuple(sorted(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) % (1 << 64)).bit_count() <= radius}
        assert {(r.a, r.b) for r in hamming_links(df, radius, segments).collect()} == want


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    draw.shuffle(links)
    want = brute_roots({x for p in links for x in p if p[0] != p[1]}, links)
    got = smallest_reachable(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {x: r for x, r in want.items() if x != r}
    assert smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_steps_over_few_edges_have_few_tasks(spark):
    """Tasks, each with files of its own, follow the number of edges, however wide the shuffle is."""
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = [(i, i + 1) for i in range(40)] + [(5000, i) for i in range(5001, 6001)]
    edges = write_table(spark.createDataFrame(links, "a bigint, b bigint"), "links")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "components of few edges")
        roots = smallest_reachable(edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(roots.inputFiles()) <= sc.defaultParallelism
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few-tasks") for s in seen.getJobInfo(j).stageIds}
    tasks = [x.numCompletedTasks for x in map(seen.getStageInfo, stages) if x]
    assert sum(tasks) > 0 and max(tasks) < 100
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(1, 41)} | {(i, 5000) for i in range(5001, 6001)}


def test_table(spark):
    texts = prose(40)
    long = " ".join(prose(1, seed=5, words=3000, vocabulary=900) * 1)
    words = (" ".join(prose(80, seed=6))).split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(0, len(words), 200)]
    df, rows = awkward(spark, [*texts, " ".join(words), *near], long)
    prints = {t or "": brute_print(t or "") for _, t in rows}
    linked = [p for p in combinations(set(prints.values()), 2) if (p[0] ^ p[1]).bit_count() <= 3]
    assert linked
    roots = brute_roots(set(prints.values()), linked)
    first = {}
    for i, t in rows:
        if i is not None:
            r = roots[prints[t or ""]]
            first[r] = min(first.get(r, i), i)
    want = sorted(((i, prints[t or ""], first.get(roots[prints[t or ""]])) for i, t in rows), key=str)
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    assert near_duplicates(empty(spark)).count() == 0
