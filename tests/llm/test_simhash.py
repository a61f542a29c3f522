import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from gristmill.llm import simhash
from gristmill.llm._tokens import texts_of
from gristmill.llm.components import connected_components

SCHEMA = "doc_id long, text string, _fp string, _ID string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def some_texts():
    rng = random.Random(3)
    parts = ["a", "B", "é", "日", "\n", " ", "\t", "xYz", "\x00", "Ünï", "l" * 24, " ", "  "]
    texts = [None, "", "  ", "a", "a b", "a b c", "A b C"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    return texts + ["w%d " % i * 3 for i in range(20)] + [" ".join("w%d" % rng.randint(0, 50) for _ in range(4000))]


def test_fingerprints_equal_a_plain_version_however_texts_are_cut():
    texts = some_texts()
    for most in (40, 1000, 1 << 20):
        got = np.concatenate([simhash.text_fingerprints(t, 3, 42) for t in texts_of(pa.array(texts), most)])
        assert got.tolist() == [brute_fingerprint(t) for t in texts]


def near(rng, base, n, bits):
    out = set()
    while len(out) < n:
        x = base
        for b in rng.sample(range(64), rng.randint(0, bits)):
            x ^= 1 << b
        out.add(x)
    return out


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(5)
    fps = near(rng, rng.getrandbits(64), 300, 4) | near(rng, rng.getrandbits(64), 40, 6) | {rng.getrandbits(64) for _ in range(200)} | {0, 1, 7, 15, (1 << 64) - 1}
    fps = sorted(fps)
    root = brute_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for block, large in ((512, 16384), (16, 40)):  # buckets in one task; in pairs of blocks and by more bits
        simhash.BLOCK, simhash.LARGE = block, large
        try:
            links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
            found = {r.node: r.component for r in connected_components(links).collect()}
        finally:
            simhash.BLOCK, simhash.LARGE = 512, 16384
        groups = {}
        for x, r in zip(signed, root, strict=True):
            groups.setdefault(r, set()).add(found.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = list(zip(order[:-1], order[1:], strict=True)) + [(100, 101), (103, 102), (102, 103), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(60)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_rows_of_every_kind(spark):
    texts = some_texts()
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(5, texts[5], "x", None), (None, "a b c", None, None), (None, "quite alone here now", None, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    key = lambda r: tuple(map(str, r))
    expected = sorted(((r[0], f, least.get(g)) for r, f, g in zip(rows, fps, root, strict=True)), key=key)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=key) == expected
    left = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text", "_fp", "_ID"]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(least.get(g)) for g in set(root))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.one_of_each(none).collect() == []


def test_pivots_discard_no_pair_within_the_radius():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    other = fp ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    for p in simhash.PIVOTS:
        assert (np.abs(np.bitwise_count(fp ^ p).astype(int) - np.bitwise_count(other ^ p).astype(int)) <= 3).all()
