import random
import re
import zlib
from hashlib import sha256
from itertools import groupby

import pytest

from elastrain.llm import conversations as C


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All prefixes of mended roles by breadth, keeping every (cost, audit, rows) that could still win: plain search."""
    pattern = re.compile("(s?(ua)+)?$")
    begins = re.compile("s?(ua)*u?$")
    best = {("", 0): (0, "", ())}
    for i in range(len(rows) + 1):
        # two insertions at one place are never beaten by more
        for _ in range(2):
            for (made, at), (cost, audit, said) in list(best.items()):
                for role in ("user", "assistant"):
                    now = made[:1] + made[1:][-1:] + role[0]
                    if at == i and begins.match(made + role[0]):
                        keep(best, (short(made + role[0]), i), (cost + 2, audit + "I", (*said, (role, ""))))
        if i == len(rows):
            break
        (role, text), fault = rows[i], found[i]
        for (made, at), (cost, audit, said) in list(best.items()):
            if at != i:
                continue
            keep(best, (made, i + 1), (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            paid = cost + (fault == "truncated")
            for letter, more, to in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                if begins.match(made + to[:1]):
                    keep(best, (short(made + to[:1]), i + 1), (paid + more, audit + letter, (*said, (to, text))))
    return min(way for (made, at), way in best.items() if at == len(rows) and pattern.match(made))


def short(made):
    """Roles so far up to what matters: their first ones and whether a user is to be answered."""
    return made if len(made) <= 3 else made[:-2]


def keep(best, item, way):
    if item not in best or way[:2] < best[item][:2]:
        best[item] = way


def brute(rows):
    first = lambda r: (r[0] is not None, r[0] or 0)
    ordered = sorted(rows, key=lambda r: (first(r), r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    out = {}
    for conv, members in groupby(ordered, key=lambda r: r[0]):
        members = list(members)
        said = [(r[2], r[3]) for r in members]
        found = faults(said)
        turns = [r[1] for r in members if r[1] is not None]
        two = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit, made = cheapest(said, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(t not in ("su", "ua", "au") for t in two), cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


NOTHING = (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())


def made_up(n, seed=13, long=0):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "cut of", "", " \t", "Why?  ", "É wa\nit.", "a.\x85", "stop"]
    for conv in range(n):
        for turn in range(draw.randint(1, 9) if conv or not long else long):
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), draw.choice([*texts, f"{turn}.", None])))
    return rows + rows[:5] + [(None, 1, "user", "no id."), (None, None, None, None), (-5, 2**40, "assistant", "x " * 50_000)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, piece int, fault string, `odd name` int"


def test_table(spark):
    rows = made_up(80)
    df = spark.createDataFrame([(*r, "a", 1, "f", 2) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in C.report(C.damage(df), df).collect()}
    want = brute(brute_damage(rows))
    assert got == {conv: want.get(conv, NOTHING) for conv in {r[0] for r in rows}}
    none = df.where("false")
    assert C.report(C.damage(none), none).count() == 0


def test_a_long_conversation_is_split_over_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    rows = made_up(12, seed=5, long=900)
    df = spark.createDataFrame([(*r, "a", 1, "f", 2) for r in rows], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = C.judged(df)
        repairs = C.repair(runs)
        got = {r.conv_id: tuple(r)[1:] for r in C.report(df, df).collect()}
        rows_out = C.repaired_rows(runs, repairs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = brute(plain)
    assert got == want
    mended = {}
    for r in sorted(rows_out, key=lambda r: (str(r.conv_id), r.place)):
        mended.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha256("\n".join(m).encode()).hexdigest() for c, m in mended.items()} == {c: w[-1] for c, w in want.items() if w[-1] != NOTHING[-1]}


@pytest.mark.parametrize("cut", [1, 3, 8])
def test_items_of_parts_join_to_those_of_the_whole(cut):
    draw = random.Random(cut)
    for _ in range(40):
        rows = [(draw.choice("suuaat"), draw.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(draw.randint(1, 12))]
        whole = C.block_items(rows)
        parts = [C.block_items(rows[i : i + cut]) for i in range(0, len(rows), cut)]
        made = parts[0]
        for part in parts[1:]:
            made = C.joined(made, part)
        assert made == whole
        assert C.cheapest(whole) == C.lightest(rows, C.ENDS, C.START)[C.START]


def test_identical_rows_in_great_number(spark):
    rows = [(1, 0, "user", "Hi.")] * 3000 + [(1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = C.report(df, df).first()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (2999, 2999, 2999 * 3, "K" + "D" * 2999 + "K")
