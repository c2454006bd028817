"""Spelling variants against a plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from assetlake.llm import queries, spelling


def plain(n, times=2):
    """word: (form, root, n, n_near, form_n) from word: n, each word against the words that one edit makes."""
    near = {w: set() for w in n}
    for a in n:
        for i in range(len(a) + 1):
            if i < len(a) and a[:i] + a[i + 1:] in n:
                b = a[:i] + a[i + 1:]
                near[a].add(b)
                near[b].add(a)
    gaps = {}
    for a in n:
        for i in range(len(a)):
            gaps.setdefault((a[:i], a[i + 1:]), []).append(a)
    for same in gaps.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= times * n[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] is not None else None) for a in n}


def as_plain(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("tile_rows, block_rows", [(8192, 1024), (100_000, 7), (20, 3), (1, 1)])
def test_against_all_pairs(spark, monkeypatch, tile_rows, block_rows):
    rng = random.Random(tile_rows)
    letters = ["a", "b", "é", "e", "ß", "日", "😀", "\0", " "]
    n = {"".join(rng.choices(letters[:rng.choice([2, 3, 9])], k=rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 7, 12]))): rng.choice([1, 2, 3, 5, 9, 30, 90]) for _ in range(900)}
    base = "x" * 300
    n |= {base: 9, base + "x": 4, base[1:] + "y": 1, "y" + base[1:]: 2, "z" * 301: 1}
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda w, total: near(w, total, tile_rows, block_rows))
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert as_plain(spelling.variants(df).collect()) == plain(n)


def test_hot_head_is_cut_into_blocks(spark):
    words = {f"aaaaa{k:05d}": 1 + k % 7 for k in range(3000)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: r for r in spelling.near_words(df, len(words), block_rows=200).collect()}
    want = plain(words)
    assert {w: r.n_near for w, r in found.items()} == {w: t[3] for w, t in want.items() if t[3]}


def test_odd_tables(spark):
    kind = "word string, n long, root string, i int, _j int"
    assert spelling.variants(spark.createDataFrame([], kind)).collect() == []
    rows = [("abcde", 2, "r", 1, 1), ("abcde", 1, "r", 1, 1), (None, 5, "r", 1, 1), ("abcdf", None, "r", 1, 1), ("abcdx", 6, "r", 1, 1), ("", 4, "r", 1, 1)]
    assert as_plain(spelling.variants(spark.createDataFrame(rows, kind)).collect()) == plain({"abcde": 3, "abcdx": 6, "": 4})
    chain = {"a" * k: 3 ** k for k in range(1, 31)}
    got = as_plain(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect())
    assert {r[1] for r in got.values()} == {"a" * 30}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], kind), times=1)


def test_op11_against_all_pairs_and_sql(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Größe größe GRÖSSE x " * 50), (-4, "z" * 20_000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for doc, text in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    want = plain({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})
    assert any(t[0] for t in want.values())
    got = queries.queries()["op11_spelling_variants"](spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert as_plain(got.collect()) == want
    db = duckdb.connect()
    db.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    rows = db.sql(queries.oracle_sql()["op11_spelling_variants"]).fetchall()
    assert {r[0]: r[1:] for r in rows} == want
