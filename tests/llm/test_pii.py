import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import oracles, pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ 0425%é\n()", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS] == plain_spans(text)


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert [s.kind for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, ok")] == ["iban"]
    assert [s.kind for s in pii.find_spans("GB83 WEST 1234 5698 7654 32")] == []


def test_context_words_adjust_the_score():
    near, far, against = (pii.find_spans(t)[0].score for t in ("phone +1 (663) 555-6869", "+1 (663) 555-6869", "order +1 (663) 555-6869"))
    assert near > far > against
    assert [s.kind for s in pii.find_spans("social security 123-45-6789")] == ["ssn"]
    assert pii.find_spans("part 123-45-6789") == []


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 500_000, "1." * 300_000, "a@" * 300_000, "+1" + " " * 500_000, "a" * 300_000 + "@b.cc"):
        pii.find_spans(text)


def test_rows_of_every_kind(spark):
    texts = [None, "", "none", "é a.b@c.de, 10.0.0.300 10.0.0.30", "4111 1111 1111 1111", "x" * 200_000 + " a@b.cc"]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)] + [(3, texts[3], "s", 3), (None, "a@b.cc", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, found int")
    got = pii.digest(pii.detect(df)).collect()
    assert len(got) == len(rows)
    text_of = dict(enumerate(texts)) | {None: "a@b.cc"}
    for r in got:
        spans = plain_spans(text_of[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS)
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert {r.text for r in clean.where("doc_id = 3").collect()} == {"é [EMAIL], 10.0.0.300 [IP]"}
    assert clean.where("doc_id is null").first().text == "[EMAIL]"
    assert pii.detect(df.limit(0)).collect() == [] and pii.redact(df.limit(0)).collect() == []


def test_equals_its_sql_on_awkward_texts(spark, tmp_path):
    texts = [None, "", "a@b.c@d.e f@g..h i@j.k", "1.2.3.4.5.6.7.8 001.2.3.256 999999999999999999999.1.1.1", "4111-1111 1111-1111 4111111111111112 55555555555544440", "+1 (663) 555-6869 ++12345678 +12", "GB82 WEST 1234 5698 7654 32. GB83 WEST 1234 5698 7654 32", "my SSN 123-45-6789, test ssn 123-45-6789", "social 000-12-3456 é@é.é ü.ü@x.yz"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = pii.digest(pii.detect(spark.read.parquet(str(tmp_path / "d")))).drop("scores")
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(oracles.OP1).select(*got.columns).fetchall())
