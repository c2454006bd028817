"""Vector and archive operators against plain versions, with odd rows."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm import ann, itq, warc


def vectors(n=1500, d=64, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v[100:160] = v[7] + rng.standard_normal((60, d)) * 0.02
    v[200:230] = v[8]
    v[300] = v[9] * 3
    return (v * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    v = vectors()
    rows = [(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)]
    odd = [(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] + [1.0] * 63, 0), (9004, [None] + [1.0] * 63, 1), (9005, [1.0, 2.0], 1),
           (9006, [], 1), (None, [float(x) for x in v[0]], 0), (9007, [float("inf")] + [1.0] * 63, 0)]
    return v, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, number long").repartition(3)


def test_links(table):
    v, df = table
    out = {r.vec_id: r for r in itq.near_duplicates(df).collect() if r.vec_id is not None}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(u))
    for _ in range(20):
        label = np.minimum(label, np.where(near, label[None, :], len(u)).min(axis=1))
    for i in range(len(u)):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[i].sum(), label[i], label[i] == i)
    for i in range(9001, 9008):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert itq.near_duplicates(df).count() == df.count() and itq.near_duplicates(df.filter("false")).count() == 0
    assert itq.near_duplicates(df.filter("vec_id > 9000")).count() == 7


def test_pairs_at_the_limit_meet():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    mean, turn = itq.fit_rotation(x)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1)[:, None]
    apart = (((x - mean) @ turn > 0) != ((y - mean) @ turn > 0)).sum(axis=1)
    assert (apart <= itq.RADIUS).mean() > 0.95


@pytest.mark.parametrize(("shared", "least"), [(0.7, 0.95), (0.85, 0.95), (0.0, 0.8), (0.0, 0.5)])
def test_pairs_at_the_limit_meet_whatever_the_mean_and_limit(spark, shared, least):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 64))
    x[:, 1:] /= np.linalg.norm(x[:, 1:], axis=1)[:, None]
    x = np.hstack([np.full((1200, 1), np.sqrt(shared)), np.sqrt(1 - shared) * x[:, 1:]])
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    at = least + 1e-4
    y = at * x + np.sqrt(1 - at**2) * side / np.linalg.norm(side, axis=1)[:, None]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(np.vstack([x, y]))]
    out = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=least).collect()}
    both = np.vstack([x, y])
    near = both @ both.T >= least
    want = near.sum(axis=1) - 1
    assert want.min() >= 1 and sum(out.values()) >= 0.96 * want.sum() and all(out[i] <= want[i] for i in out)


def test_code_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(6)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for c in list(codes):
        for _ in range(4):
            d = c
            for b in rng.sample(range(64), rng.randint(0, 13)):
                d ^= 1 << b
            codes.append(d)
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "number long, code long")
    got = sorted((r.a, r.b) for r in itq.code_pairs(df).collect())
    assert got == sorted((j, i) for i, a in enumerate(codes) for j, b in enumerate(codes[:i]) if (a ^ b).bit_count() <= itq.RADIUS)


def test_search(table):
    v, df = table
    out = {}
    for r in ann.search(df, lambda i: i % 20 == 0, list_rows=100, block_rows=64).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x, found, total = v.astype(np.float64), 0, 0
    assert sorted(out) == list(range(0, 1500, 20))
    for q, rows in out.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in [i for _, i, _ in rows]
        assert all(abs(s - score[i]) < 1e-9 for _, i, s in rows)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:]))
        found, total = found + len(set(best) & {i for _, i, _ in rows}), total + 20
    assert found / total >= 0.9
    few = ann.search(df.filter("vec_id < 5 or vec_id > 9000"), lambda i: i == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert ann.search(df.filter("false"), lambda i: i % 20 == 0).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html>" + "x" * 200 + "é</html>"
    rows = [(i, f"http://a/{i}\nb c" if i % 3 else None, f"<p>{i}</p>" * (i % 40), 1) for i in range(300)]
    rows += [(1000 + i, "http://c", body, 2) for i in range(50)] + [(990, "u", "short", 0), (991, "u", "short", 0), (992, None, None, 0), (993, "", "", 0)]
    rows += [(None, "n", body, 0), (1000, "again", body, 0), (1000, "again", body, 0), (994, "l", "long " * 100_000, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, _digest int")


def test_round_trip(spark, pages, tmp_path):
    files = {}
    for name, parts in (("a", 3), ("b", 7)):
        root = str(tmp_path / name)
        manifest = warc.write_archives(pages.repartition(parts), root, file_bytes=3000, shard_bytes=20_000).collect()
        files[name] = sorted((m.file, m.sha256, m.records) for m in manifest)
        for m in manifest:
            assert hashlib.sha256(open(f"{root}/{m.file}", "rb").read()).hexdigest() == m.sha256
        assert not os.path.exists(f"{root}/_temporary")
    assert files["a"] == files["b"] and len(files["a"]) > 5
    back = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(back) == pages.count()
    first = {}
    for r in pages.collect():
        key = r.html or ""
        if r.page_id is not None and len(key.encode()) >= 100:
            first[key] = min(first.get(key, r.page_id), r.page_id)
    texts = {r.page_id: r.html or "" for r in pages.collect() if r.page_id is not None}
    for r in back:
        if r.page_id is None:
            assert r.record_type == "response"
            continue
        text = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
        if r.record_type == "response":
            assert r.payload.decode() == text and r.refers_to is None
        else:
            assert r.refers_to == first[text] <= r.page_id
    assert sum(r.record_type == "revisit" for r in back) == 49 + 2
    root = str(tmp_path / "none")
    assert warc.write_archives(pages.filter("false"), root).count() == 0 and warc.read_archives(spark, root).count() == 0


def test_shards_roll_by_default(spark, tmp_path):
    noise = F.concat_ws("", F.transform(
        F.sequence(F.lit(1), F.lit(6000)), lambda i: F.sha2(F.concat_ws("-", F.col("id").cast("string"), i.cast("string")), 256)))
    pages = spark.range(0, 100, 1, 8).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), noise.alias("html"))
    root = str(tmp_path / "default")
    manifest = warc.write_archives(pages, root).collect()
    parts = {s: sum(m.shard == s for m in manifest) for s in {m.shard for m in manifest}}
    assert len(parts) == 3 and min(parts.values()) >= 2 and sum(m.records for m in manifest) == 100
    assert all(m.bytes < (2 << 20) + 400_000 for m in manifest)
    # A repeated run replaces what an attempt that was lost has left.
    os.makedirs(f"{root}/_temporary")
    open(f"{root}/_temporary/lost", "w").close()
    assert sorted(warc.write_archives(pages, root).collect()) == sorted(manifest) and not os.path.exists(f"{root}/_temporary")
    back = warc.read_archives(spark, root, payloads=False).collect()
    assert sorted(r.page_id for r in back) == list(range(100)) and {r.payload_bytes for r in back} == {6000 * 64}
