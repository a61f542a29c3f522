from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import _shared
from gristmill.llm._tokens import shingle_hashes, squeeze, texts_of, word_hashes, words


def test_settled_tables_lie_in_the_shared_folder_until_dropped(spark):
    kept, _shared._written[:] = list(_shared._written), []
    df = _shared.settle(spark.range(5), "numbers")
    path = Path(_shared._written[0][1].removeprefix("file:"))
    assert df.count() == 5 and path.is_dir() and str(path).startswith(_shared.shared_dir(spark).removeprefix("file:"))
    _shared.drop_scratch()
    assert not path.exists() and _shared._written == []
    _shared._written[:] = kept


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "yarn"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session())


def test_word_hashes_do_not_depend_on_place_or_case():
    texts = pa.array(["The cat", None, "", "  the\tCAT\n", "é" * 3000 + " the cat", "x" * 5000 + "\x0bthe"])
    for most in (1, 100, 1 << 20):
        seen = []
        for t in texts_of(texts, most):
            starts, ends, first = words(t)
            h = word_hashes(t.data, starts, ends)
            seen += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert seen[0] == seen[3] == seen[4][1:] and seen[1] == seen[2] == [] and seen[5][1] == seen[0][0]
        assert len({*seen[0], seen[4][0], seen[5][0]}) == 4


def test_squeezing_and_shingles():
    t = next(texts_of(pa.array(["It's -- a, test!", "its a test"])))
    s = squeeze(t)
    starts, ends, first = words(s)
    h = word_hashes(s.data, starts, ends)
    assert h[: first[1]].tolist() == h[first[1] :].tolist() and len(h) == 6
    assert shingle_hashes(h, 3)[0] == shingle_hashes(h, 3)[3] and len(shingle_hashes(h[:2], 3)) == 0
    assert shingle_hashes(np.array([1, 2], np.uint64), 2)[0] != shingle_hashes(np.array([2, 1], np.uint64), 2)[0]


def test_joins_of_hot_keys_are_spread_and_whole(spark, monkeypatch):
    monkeypatch.setattr(_shared, "TOGETHER", 16)
    many = spark.range(3000).selectExpr("id AS doc", "IF(id % 3 = 0, 7, id % 50) AS h")
    one = _shared.settle(many.groupBy("h").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("h <> 8"), "one")
    got = _shared.spread_join(many, one, ["h"], "doc")
    want = many.join(one.drop("n"), "h")
    assert sorted(map(tuple, got.select("h", "doc", "least").collect())) == sorted(map(tuple, want.select("h", "doc", "least").collect()))
    parts = _shared.parted(many, ["h"], _shared.parts_of(one, ["h"], 16)).groupBy("h").agg(F.max("_parts").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.p >= r.n / 16 for r in parts if r.h != 8) and max(r.p for r in parts) > 50


def test_a_sieve_loses_nothing(spark):
    rows, wanted = spark.range(1000).selectExpr("id AS k", "'x' AS _mark_"), spark.range(0, 1000, 7).selectExpr("id AS k")
    flagged = {r.k: r.may for r in _shared.sifted(rows, ["k"], wanted, "may").collect()}
    assert len(flagged) == 1000 and all(flagged[k] for k in range(0, 1000, 7)) and sum(flagged.values()) < 160


def test_settled_tables_can_be_spent(spark):
    import os

    a = _shared.settle(spark.range(5).toDF("x"), "a")
    b = _shared.settle(a.selectExpr("x + 1 AS x"), "b", (a,))
    assert not os.path.exists(a._settled_at.removeprefix("file:")) and b.count() == 5
    _shared.release(b)
    assert not os.path.exists(b._settled_at.removeprefix("file:"))
