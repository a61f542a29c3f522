import random
import re
from collections import Counter

import duckdb
import pytest

from gristmill.llm import decontam, oracles


def norm(text):
    return [w for w in (re.sub(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]", "", x.lower()) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]


def shingles(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(text, item):
    """The best share of the item's shingles in any window of its size."""
    w, i = norm(text), norm(item)
    if not i:
        return 0.0
    if len(i) < 5:
        return float(any(w[a : a + len(i)] == i for a in range(len(w) - len(i) + 1)))
    own = shingles(i)
    return max((sum((shingles(w[a : a + len(i)]) & own).values()) / sum(own.values()) for a in range(max(1, len(w) - len(i) + 1))), default=0.0)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 8, 16, 30, 59, 59, 40)]
    items += [items[4] + " tail of words", None, "", "!!", "to be or not to be or not to be or not to be"]
    docs = [None, "", "x" * 100_000, " ".join(word() for _ in range(3000))]
    for item in items:
        for edits in range(5):
            w = (item or "").split()
            for _ in range(edits):
                if w:
                    w[rng.randrange(len(w))] = word()
            docs.append(" ".join([word() for _ in range(rng.randint(0, 80))] + w + [word() for _ in range(rng.randint(0, 80))]))
        docs.append((item or "").upper().replace(" ", ", ") + "!!")
    return docs, items


@pytest.mark.parametrize("per_pass", [1000, 3])
def test_equals_brute_force_over_all_windows(spark, per_pass):
    docs, items = corpus(4)
    d = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(docs)], "doc_id long, text string, similarity double")
    b = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(d, b, items_per_pass=per_pass).collect()}
    want = {(i, j): s for i, t in enumerate(docs) for j, x in enumerate(items) if (s := brute(t, x)) >= 0.8}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    kept = decontam.clean(d, b, items_per_pass=per_pass)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - {i for i, _ in want})


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three four five six"), (1, None)], "item_id long, text string")
    some = spark.createDataFrame([(None, "zero one two three four five six"), (None, "zero one two three four five six")], "doc_id long, text string")
    assert decontam.contaminated(none, items).collect() == []
    assert decontam.contaminated(some, items.limit(0)).collect() == []
    assert decontam.clean(some, items.limit(0)).count() == 2 and decontam.clean(some, items).count() == 0
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(some, items).collect()] == [(None, None)] * 2


def test_blocks_hold_all_within_the_radius():
    rng = random.Random(1)
    index = decontam.ItemIndex(list(range(50)), [" ".join(str(rng.random()) for _ in range(20)) for _ in range(50)])
    import numpy as np

    for i in range(50):
        x = int(index.prints[i])
        for b in rng.sample(range(64), decontam.RADIUS):
            x ^= 1 << b
        size = int(index.size[i])
        assert i in [j for j, _ in index.near_items(np.array([x], dtype=np.uint64), size)]


def test_equals_its_sql(spark, tmp_path):
    docs, items = corpus(8)
    items = [x for x in items if x is None or len(norm(x)) >= 5]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(20, docs[20])], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "b"))
    db = duckdb.connect()
    for name, path in (("documents", "d"), ("benchmark", "b")):
        db.sql(f"create view {name} as select * from '{tmp_path}/{path}/*.parquet'")
    got = decontam.contaminated(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "b")))
    rows = sorted((*r[:2], round(r[2], 9), *r[3:]) for r in map(tuple, got.collect()))
    assert rows == sorted((*r[:2], round(r[2], 9), *r[3:]) for r in db.sql(oracles.OP8).select(*got.columns).fetchall())
    assert len(rows) > 20


@pytest.mark.parametrize("size", [50, 100, 200])
def test_filler_in_a_window_hides_no_item(spark, size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, docs = [], []
    for n in range(12):
        w = [word() for _ in range(size)]
        items.append(" ".join(w))
        cut = size // 6  # the item's end, begun by a run of one word, or its middle masked by one
        docs.append(" ".join(["[MASK]"] * cut + w[cut:] if n % 2 else w[: size // 2] + ["[MASK]"] * cut + w[size // 2 + cut :]))
    docs.append(" ".join(w[:3] * size))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(d, b, similarity=0.6).collect()}
    want = {(i, j): s for i, t in enumerate(docs) for j, x in enumerate(items) if (s := brute(t, x)) >= 0.6}
    assert len(want) == 12 and got == pytest.approx(want)
