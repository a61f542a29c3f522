import random
import re

import duckdb
import pytest

from gristmill.llm import mixing, oracles

SCHEMA = "doc_id long, text string, source string, size string, target int"


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of(seed, n=400):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "hot", "tiny"]
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources[:-1])
        rows.append((i, rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 else "w " * rng.randint(1, 300), s, "x", 1))
    rows.append((n, "one two three", "tiny", None, None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = rows_of(seed)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    of = {r[0]: r for r in rows}
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", of[r.doc_id][1] or ""))
        s = of[r.doc_id][2]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    targets = plain_targets(sizes)
    for r in got:
        s = of[r.doc_id][2]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s], rel=1e-12)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 4 * mixing.BLOCK
    again = mixing.mix(spark.createDataFrame(random.Random(0).sample(rows, len(rows)), SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_equals_its_sql(spark, tmp_path):
    rows = [r[:3] for r in rows_of(3)] + [(None, "a b", "a")] * 2 + [(7, "x y z", "B")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    key = lambda r: tuple(map(str, r))
    small = (mixing.SHARD_WORDS, mixing.SHARD_DOCS, mixing.SHARD_GROUP)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=key) == sorted(db.sql(oracles.OP7).fetchall(), key=key)
    assert small == (1 << 18, 512, 1024)


def test_many_shards_take_the_quota(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 500), ("SHARD_DOCS", 10), ("SHARD_GROUP", 4)):
        monkeypatch.setattr(mixing, name, value)
    got = mixing.mix(spark.createDataFrame(rows_of(4), SCHEMA)).collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - total) < 0.05 * total
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_apportion_equals_highest_quotients(spark):
    rng = random.Random(9)
    parties = [(g, p, rng.choice([0, 1, 3, 3, 50, 700]), 1 + 13 * g, rng.choice([2, 9, 500])) for g in range(12) for p in range(rng.randint(1, 9))]
    got = mixing.apportion(spark.createDataFrame(parties, "g int, p int, votes long, seats long, most long"), ["g"], "p", "votes", "seats", "most").collect()
    quota = {(r.g, r.p): r.quota for r in got}
    for g in range(12):
        own = [x for x in parties if x[0] == g]
        quotients = sorted(((-v / (2 * k + 1), p, k) for _, p, v, _, most in own if v for k in range(most)))[: 1 + 13 * g]
        expected = {p: sum(q[1] == p for q in quotients) for _, p, *_ in own}
        capped = any(quota[g, p] == most for _, p, _, _, most in own)
        if not capped:
            assert {p: quota[g, p] for _, p, *_ in own} == expected
        assert all(quota[g, p] <= most for _, p, _, _, most in own)


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_rows_that_repeat_are_rows_of_their_own(spark, tmp_path, monkeypatch):
    """Null and repeated ids in thousands, very long texts and clashing columns, against SQL that lists every row."""
    import duckdb

    from gristmill.llm import mixing, oracles

    monkeypatch.setattr(mixing, "COPIES", 64)
    rows = [(None, "a b c", "s1")] * 700 + [(None, "a b", "s1")] * 300 + [(7, "x y z u v", "s2")] * 500 + [(i, "w " * (i % 40), f"s{i % 3}") for i in range(300)] + [(1000, "long " * 200_000, None), (1001, None, None), (1002, "", "s0")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'t' AS taken", "2 AS copies", "3 AS sid").repartition(4).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view documents as select doc_id, text, source from '{path}/*.parquet'")
    got = mixing.mix(spark.read.parquet(path))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(db.sql(oracles.OP7).select(*got.columns).fetchall(), key=key)
    assert got.count() == len(rows) and mixing.mix(spark.read.parquet(path).limit(0)).collect() == []
