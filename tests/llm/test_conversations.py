"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from assetlake.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        tail = text.rstrip(SPACE)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows):
    """Cost, edits and repaired turns of (turn, role, text) in order, by trying every edit at every place."""
    bad = faults(rows)
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @functools.cache
    def best(i, at, inserts):
        ways = [(0, "", ())] if i == len(rows) and at in (0, 3) else []

        def go(edit, cost, to, turn, i, inserts=0):
            if to is not None:
                c, e, t = best(i, to, inserts)
                ways.append((cost + c, edit + e, (turn, *t) if turn else t))

        if inserts < 3:
            for role in ("user", "assistant"):
                go("I", 2, after.get((at, role[0])), (role, ""), i, inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            more = int(bad[i] == "truncated")
            go("D", 3, at, None, i + 1)
            if bad[i] not in ("blank", "duplicate"):
                go("K", more, after.get((at, role[:1])), (role, text), i + 1)
                for new in ("user", "assistant"):
                    go("R", 2 + more, after.get((at, new[0])), (new, text), i + 1)
        return min(ways, default=(10**9, "", ()))

    return best(0, 0, 0)


def audit(rows):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    bad, (cost, edits, turns) = faults(rows), plain(rows)
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, edits, sha)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def some_turns(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "umpire", "", "Assistant"], ["Yes.", "No!", "Well", "Hm ", "", " \n", "Why? ", "é…", "Ja."]
    weights = [6, 6, 2, 1, 1, 1, 1]
    return [(rng.choice([None, *range(9)]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.7 else f"{rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("block_rows", [2, 1 << 16])
def test_against_every_edit(spark, block_rows):
    rng = random.Random(block_rows)
    talks = {k: some_turns(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 14])) for k in [None, *range(600)]}
    talks[601] = some_turns(rng, 80)
    rows = [(k, *t) for k, turns in talks.items() for t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.audits(df, block_rows=block_rows).collect()}
    assert got == {k: audit(turns) for k, turns in talks.items()}


def test_edits_make_the_repaired_conversation(spark):
    rng = random.Random(3)
    talks = {f"c{k}": some_turns(rng, 8) for k in range(100)}
    df = spark.createDataFrame([(k, *t) for k, turns in talks.items() for t in turns], "name string, nr int, who string, said string")
    found = conversations.repair(df, "name", "nr", "who", "said", block_chars=300).collect()
    for name, turns in talks.items():
        mine = sorted((r for r in found if r.name == name), key=lambda r: r.step)
        assert [r.step for r in mine] == list(range(len(mine)))
        ordered = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, edits, made = plain(ordered)
        assert "".join(r.edit for r in mine) == edits
        assert [(r.role, r.text) for r in mine if r.role is not None] == list(made)
        assert [(r.turn, r.old_role, r.text) for r in mine if r.edit != "I"] == ordered
        assert [r.fault for r in mine if r.edit != "I"] == faults(ordered)


def test_odd_tables(spark):
    kind = "conv_id string, turn long, role string, text string, conv long, fault string, copy int, step int"
    none = spark.createDataFrame([], kind)
    assert conversations.audits(none).collect() == [] and conversations.repair(none).collect() == []
    long = "word " * 400_000
    rows = [("a", 0, None, None), ("a", 1, "user", long), ("a", 1, "user", long), ("a", None, "assistant", "Yes."), (None, None, None, None)]
    got = {r.conv_id: r for r in conversations.audits(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], kind)).collect()}
    clean = [(t, r or " ", x or " ") for c, t, r, x in rows if c]
    assert tuple(got["a"][c] for c in COLUMNS) == audit(clean)
    assert tuple(got[None][c] for c in COLUMNS) == audit([(None, " ", " ")])


def test_one_conversation_with_a_third_of_all_turns_spills(spark):
    n = 60_000
    hot = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    rest = spark.range(2 * n).selectExpr("100 + id as conv_id", "0L as turn", "'user' as role", "'Hm.' as text")
    got = conversations.audits(hot.unionByName(rest), block_rows=1000)
    assert got.filter("conv_id = 7").first().audit == "K" * n
    assert got.filter("conv_id <> 7 and audit = 'D' and cost = 3").count() == 0
    assert got.filter("conv_id <> 7 and audit = 'KI' and cost = 2").count() == 2 * n


def test_op12_against_every_edit(spark, tmp_path):
    odd = [(-1, None, None, None), (-1, 3, "user", None), (None, 1, "user", "Yes."), (None, 2, "assistant", "No."), (-2, None, "system", "Hm")]
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").unionByName(
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    talks: dict = {}
    for conv, turn, role, text in rows.select("conv_id", "turn", "role", "text").collect():
        talk = talks.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            talk += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    got = queries.queries()["op12_conversation_repair"](spark, str(tmp_path))
    assert got.dtypes == [("conv_id", "bigint")] + [(c, "string" if c in ("audit", "repaired_sha256") else "bigint") for c in COLUMNS]
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == {k: audit(t) for k, t in talks.items()}
