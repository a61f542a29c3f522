"""DuckDB SQL for the operators that SQL can express, written from their contracts rather than from their plans."""

from __future__ import annotations

from gristmill.llm import decontam, mixing, pii, quality_rules

_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TRIMMED = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _bits() -> str:
    return " + ".join(f"CASE WHEN {failed} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, failed in quality_rules.RULES)


OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: {_TRIMMED} <> '') AS ls FROM d),
windows AS (SELECT r, p, array_to_string(ws[p:p + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
repeated AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n FROM repeated, range(5) AS five(k) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations, len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, ({_bits()})::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (fail_bits & {quality_rules.POLICIES[quality_rules.CURRENT]}) = 0 AS kept, fail_bits
FROM b
"""

#: Base 32 of a SHA-1 from its 40 hexadecimal digits: each five digits are four letters.
OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
five AS (SELECT page_id, html, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: instr('0123456789ABCDEF', hex[i * 5 + j + 1]) - 1), lambda a, x: a * 16 + x)) AS n FROM p),
d AS (
  SELECT page_id, html, array_to_string(list_transform(n, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM five)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def _hash(value: str, salt: int) -> str:
    m, f = mixing._MODULUS, mixing._FACTOR
    return f"(((((coalesce({value}, 0) % {m} + {m}) % {m}) * {f} + {mixing.SEED * 1009 + salt}) % {m}) * {f}) % {m}"


def _quota(name: str, parties: str, within: str, party: str, votes: str, seats: str, most: str, keep: str) -> str:
    """Sainte-Laguë by listing every quotient of every party."""
    over = f"PARTITION BY {within} " if within else ""
    return f"""{name}_q AS (SELECT *, row_number() OVER ({over}ORDER BY {votes}::DOUBLE / (2 * k + 1) DESC, {party}, k) AS place
  FROM (SELECT *, unnest(range(0, {most})) AS k FROM {parties})),
{name} AS (SELECT {keep}, count(*) FILTER (WHERE place <= {seats}) AS quota FROM {name}_q GROUP BY {keep})"""


_B, _E = mixing.BLOCK, mixing.EPOCHS
OP7 = f"""
WITH sizes AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, sum(source_size) OVER ()::BIGINT AS total FROM src),
weighed AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1]::BIGINT AS weight FROM ranked),
filling AS (
  SELECT *, coalesce(sum({_E} * source_size) OVER (ORDER BY source_size * {_E} / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         sum(weight) OVER (ORDER BY source_size * {_E} / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM weighed),
opened AS (SELECT filled, open_weight FROM filling WHERE {_E} * source_size * open_weight > (total - filled) * weight ORDER BY filled, open_weight DESC LIMIT 1),
targets AS (
  SELECT f.sid, f.source, f.source_size, f.docs, f.total,
         CASE WHEN o.filled IS NULL THEN ({_E} * f.source_size)::DOUBLE ELSE least((f.total - o.filled)::DOUBLE * f.weight / o.open_weight, ({_E} * f.source_size)::DOUBLE) END AS target
  FROM filling f LEFT JOIN opened o ON true),
parties AS (
  SELECT *, round(sum(target) OVER () / {_B})::BIGINT AS seats, ceil(source_size / {_B})::BIGINT * {_E} AS most,
         greatest(ceil(source_size / {mixing.SHARD_WORDS}), ceil(docs / {mixing.SHARD_DOCS}), 1)::BIGINT AS shards
  FROM targets),
{_quota("s", "parties", "", "sid", "target", "seats", "most", "sid")},
placed AS (
  SELECT z.r, z.doc_id, z.size, p.sid, p.source_size, p.target, {_hash("z.doc_id", 1)} % p.shards AS shard, {_hash("z.doc_id", 2)} AS spot
  FROM sizes z JOIN parties p ON z.source IS NOT DISTINCT FROM p.source),
lined AS (SELECT *, (sum(size) OVER (PARTITION BY sid, shard ORDER BY spot, doc_id, size, r ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first FROM placed),
shards AS (SELECT sid, shard, shard // {mixing.SHARD_GROUP} AS shard_group, sum(size)::BIGINT AS words, ceil(sum(size) / {_B})::BIGINT * {_E} AS most FROM placed GROUP BY ALL),
groups AS (SELECT g.*, s.quota AS seats FROM (SELECT sid, shard_group, sum(words)::BIGINT AS words, sum(most)::BIGINT AS most FROM shards GROUP BY ALL) g JOIN s USING (sid)),
{_quota("g", "groups", "sid", "shard_group", "words", "seats", "most", "sid, shard_group")},
inner_shards AS (SELECT h.*, g.quota AS seats FROM shards h JOIN g USING (sid, shard_group)),
{_quota("h", "inner_shards", "sid, shard_group", "shard", "words", "seats", "most", "sid, shard_group, shard, words")},
picks AS (
  SELECT sid, shard, ceil(words / {_B})::BIGINT AS n, quota,
         {list(mixing._STRIDES)}[{_hash("sid * 7919 + shard", 3)} % {len(mixing._STRIDES)} + 1]::BIGINT AS stride, {_hash("sid * 7919 + shard", 4)} AS turn
  FROM h WHERE words > 0),
blocks AS (SELECT sid, shard, k, quota // n + CASE WHEN (k * stride + turn % n) % n < quota % n THEN 1 ELSE 0 END AS copies FROM (SELECT *, unnest(range(0, n)) AS k FROM picks)),
spans AS (SELECT r, sid, shard, first, size, unnest(range(first // {_B}, (first + size - 1) // {_B} + 1)) AS k FROM lined WHERE size > 0),
got AS (
  SELECT r, sum(copies * (least(first + size, (k + 1) * {_B}) - greatest(first, k * {_B})))::BIGINT AS taken
  FROM spans JOIN blocks USING (sid, shard, k) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM lined LEFT JOIN got USING (r)
"""


def _matches(kind: str, pattern: str) -> str:
    """Start, text of every match of a pattern, from what lies between matches."""
    return f"""SELECT r, {pii.KINDS.index(kind)} AS k, '{kind}' AS kind, ms[i] AS m,
  (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT r, ms, parts, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS parts FROM d))"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN substr(reverse({_DIGITS}), i, 1)::INT * 2 - 9 ELSE substr(reverse({_DIGITS}), i, 1)::INT * 2 END)) % 10 = 0"
_CODE = "replace(m, ' ', '')"
_MOD97 = f"""list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr({_CODE}, 5) || substr({_CODE}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''), lambda c: c::INT), lambda a, x: (a * 10 + x) % 97) = 1"""
_NEAR = "lower(substr(t, greatest(s - 39, 1)::BIGINT, least(s, 40)::BIGINT) || ' ' || substr(t, (s + length(m) + 1)::BIGINT, 40))"


def _has(words: tuple[str, ...]) -> str:
    return f"regexp_matches({_NEAR}, '(^|[^\\p{{L}}])({'|'.join(words)})($|[^\\p{{L}}])')"


def _scores() -> str:
    """A span's score in tenths: where its kind starts, two up for a word of its kind nearby, two down for one of the others."""
    start = " ".join(f"WHEN '{kind}' THEN {round(score * 10)}" for kind, score in pii._START.items())
    up = " ".join(f"WHEN '{kind}' THEN {_has(words)}" for kind, words in pii._RAISE.items())
    formed = f"kind = 'secret' AND regexp_matches(m, '^({pii._KEY})')"
    return f"greatest(0, least(10, CASE WHEN {formed} THEN {round(pii._FORMED * 10)} ELSE CASE kind {start} END END + 2 * (CASE kind {up} END)::INT - 2 * ({_has(pii._LOWER)})::INT))"


OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT * FROM ({_matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")})
  UNION ALL SELECT * FROM ({_matches("ip", r"[0-9]+(?:\.[0-9]+){3}")}) WHERE list_max(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS UBIGINT), 999))) <= 255
  UNION ALL SELECT * FROM ({_matches("card", r"[0-9](?:[\x20-]?[0-9])+")}) WHERE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT * FROM ({_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15
  UNION ALL SELECT * FROM ({_matches("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")}) WHERE length({_CODE}) BETWEEN 15 AND 34 AND {_MOD97}
  UNION ALL SELECT * FROM ({_matches("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")}) WHERE NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
  UNION ALL SELECT * FROM ({_matches("secret", rf"\b(?:{pii._KEY}|[A-Fa-f0-9]{{32,128}})\b")}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 8),
scored AS (SELECT f.*, {_scores()} AS tenths FROM found f JOIN d USING (r)),
texts AS (SELECT r, k, s, kind || ':' || s || ':' || (s + length(m)) AS span, (tenths // 10) || '.' || (tenths % 10) AS score FROM scored WHERE k < 4 OR tenths >= 5)
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (WHERE k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, s), '') AS spans,
       coalesce(string_agg(score, ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN texts USING (r) GROUP BY r, doc_id
"""

_PLAIN = r"list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every window of an item's size that holds one of its shingles; items have five words at least.
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS q, item_id, {_PLAIN} AS w FROM benchmark WHERE text IS NOT NULL),
shingles AS (SELECT q, s, count(*) AS weight FROM (SELECT q, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT q, w, unnest(range(1, len(w) - 3)) AS p FROM b)) GROUP BY ALL),
totals AS (SELECT q, sum(weight) AS total FROM shingles GROUP BY q),
places AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
hits AS (SELECT r, q, p, s, weight FROM places JOIN shingles USING (s)),
windows AS (SELECT r, q, s, weight, unnest(range(greatest(1, p - (len(b.w) - 5)), least(p, greatest(len(d.w) - len(b.w) + 1, 1)) + 1)) AS place FROM hits JOIN d USING (r) JOIN b USING (q)),
held AS (SELECT r, q, place, sum(least(n, weight)) AS shared FROM (SELECT r, q, place, s, weight, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT r, q, place, shared::DOUBLE / total::DOUBLE AS similarity FROM held JOIN totals USING (q)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, q ORDER BY similarity DESC, place) AS n FROM scored WHERE similarity >= {decontam.SIMILARITY})
SELECT doc_id, item_id, similarity, place - 1 AS first_word, len(b.w)::BIGINT AS n_words FROM best JOIN d USING (r) JOIN b USING (q) WHERE n = 1
"""
