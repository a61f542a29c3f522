import base64
import gzip
import hashlib

import pytest

from gristmill.llm import warc

PAGES = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (5, "http://c", ""), (9, "u", "x\r\n\r\nWARC/1.1\r\n" * 40), (4, "http://d", "<p>é</p>"), (7, "v", "\x00\x1f" + "z" * 3_000_000)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    first = {}
    for i, _, h in sorted(pages):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in pages:
        n = len((h or "").encode())
        own = first[h or ""] == i or n < least
        out.append((i, n, digest(h), "response" if own else "revisit", None if own else first[h or ""]))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string")
    got = warc.archive_pages(df.repartition(3), str(tmp_path / "w"), least)
    assert sorted(map(tuple, got.collect())) == expected(PAGES, least)
    whole = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    for i, _, h in PAGES:
        r = whole[str(i)]
        assert r.gap_reason is None and (r.payload is None if r.record_type == "revisit" else r.payload == (h or "").encode())
    for f in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")  # any reader of gzip can read it


def test_ids_of_every_kind(spark):
    rows = [(None, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, "u", "a"), (None, None, "b"), (3, "u", "c")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    want = [(None, digest("a"), "response", None), (2, digest("a"), "response", None), (2, digest("a"), "response", None), (3, digest("a"), "revisit", 2), (None, digest("b"), "response", None), (3, digest("c"), "response", None)]
    assert found == sorted(want, key=str) or found == sorted([(None, digest("a"), "revisit", 2), *want[1:]], key=str)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).collect() == []


def archive(n, plain=()):
    parts = [warc.record_bytes(i, f"http://{i}", f"payload {i} ".encode() * 30, None) for i in range(n)]
    return [p if i in plain else warc._member(p) for i, p in enumerate(parts)]


def read(data):
    items = list(warc.read_archive(data))
    return [int(x.headers["warc-record-id"].strip("<>").rpartition(":")[2]) for x in items if isinstance(x, warc.Record)], [x for x in items if isinstance(x, warc.Gap)]


def test_reads_members_and_plain_records():
    assert read(b"".join(archive(6, plain=(1, 2, 5)))) == (list(range(6)), [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("plain", [(), range(8)])
def test_salvages_what_follows_damage(plain):
    parts = archive(8, plain)
    at = sum(map(len, parts[:3]))
    data = bytearray(b"".join(parts))
    data[at + len(parts[3]) // 2] ^= 0xFF  # a flipped byte in record 3
    ids, gaps = read(bytes(data))
    assert ids == [0, 1, 2, 4, 5, 6, 7]
    assert [(g.start, g.end) for g in gaps] == [(at, at + len(parts[3]))] and gaps[0].reason
    cut = b"".join(parts)[: -len(parts[7]) // 2]
    ids, gaps = read(cut)
    assert ids == list(range(7)) and gaps[-1].end == len(cut)
    ids, gaps = read((junk := b"garbage \x1f\x8b\x08 WARC/1.1 ") + b"".join(parts))
    assert ids == list(range(8)) and [(g.start, g.end) for g in gaps] == [(0, len(junk))]
    assert read(b"no archive at all")[0] == []


def test_quarantine_reaches_the_table(spark, tmp_path):
    (tmp_path / "x").mkdir()
    parts = archive(4)
    (tmp_path / "x" / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2] + b"\x00" * 10 + parts[3])
    rows = warc.read_archives(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert [r.record_id for r in rows if r.gap_reason is None] == ["0", "2", "3"]
    gaps = [r for r in rows if r.gap_reason]
    assert [r.end - r.start for r in gaps] == [len(parts[1]) - 9, 10]


def test_a_bad_record_in_a_member_hides_no_other():
    parts = [warc.record_bytes(i, f"http://{i}", f"payload {i} ".encode() * 30, None) for i in range(5)]
    parts[2] = parts[2].replace(b"payload 2 payload", b"payload X payload")
    both = warc._member(b"".join(parts))
    ids, gaps = read(both + warc._member(parts[0]))
    assert ids == [0, 1, 3, 4, 0] and [(g.start, g.end) for g in gaps] == [(0, len(both))] and "digest" in gaps[0].reason
    old = parts[3].replace(b"WARC/1.1", b"WARC/0.18")
    assert read(b"junk" + old + parts[4])[0] == [3, 4]
