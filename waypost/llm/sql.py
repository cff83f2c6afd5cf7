"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from waypost.llm import quality as Q

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

#: Draws of 25 shards per key; the checksum by its usual table.
SHARDING = r"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
         xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                            lambda h: ('0x' || h)::UBIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT]))) AS crc
  FROM documents, tab),
draws AS (
  SELECT doc_id, size, crc, s,
         -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM d, range(25) AS r(s)),
best AS (
  SELECT doc_id, size, crc, arg_min(s, (-score, s)) FILTER (s < 24) AS shard, arg_min(s, (-score, s)) AS grown
  FROM draws GROUP BY ALL)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || crc), 1, 8))::BIGINT % 256, doc_id, crc, size) - 1 AS slot
FROM best""".replace("GROUP BY ALL", "GROUP BY doc_id, size, crc")

#: A turn is written as the digest of its length, role and text; a node's prefix as its turns' digests.
PREFIX_TRIE = r"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 200), digest) - 1 AS pos,
         len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM plain),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::UBIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM plain), tab),
rebuilt AS (
  SELECT c.conv_id, t.digest, t.words, t.pos FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.digest, t.words, t.pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
placed AS (
  SELECT conv_id, words, row_number() OVER w AS d, string_agg(digest, '') OVER w AS p
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
members AS (SELECT conv_id, d, p, words FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(d) AS n FROM members GROUP BY conv_id),
nodes AS (
  SELECT p, d, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
         sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM members m JOIN lengths USING (conv_id) GROUP BY p, d),
kids AS (SELECT left(p, (32 * (d - 1))::BIGINT) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
up AS (
  SELECT left(p, (32 * a)::BIGINT) AS p, sum(leaf) AS n_leaves, sum(own) AS saved
  FROM (SELECT nodes.p, own, (n IS NULL)::INT AS leaf, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN kids USING (p)) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, up.n_leaves, up.saved AS saved_tokens, x.ends_sha256
FROM nodes x JOIN up USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes y ON x.d > 0 AND y.p = left(x.p, (32 * (x.d - 1))::BIGINT)"""

#: Base 32 of the bits of a SHA-1, five at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, hex(unhex(sha1(encode(body)))) AS hexes, max(page_id) OVER (PARTITION BY body) AS target FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(('0x' || hexes[i])::INT + 16), 4)), '') AS b FROM d)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: b[5 * i + k + 1]::INT << (4 - k)))::INT, 1)), '') AS payload_digest,
       CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN NULL ELSE target END AS refers_to
FROM bits"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT a, a FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

_CLASS = ", ".join(
    f"length(t) - length(regexp_replace(t, '(?:{c.replace(chr(39), chr(39) * 2)})+', '', 'g')) AS c{i}" for i, c in enumerate(Q.CLASSES)
)
_N = len(Q.CLASSES)
_KNOWN = " + ".join(f"c{i}" for i in range(_N))


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (a + b)) ELSE 0 END"
    return f"""sqrt(greatest((SELECT sum({half.format('a')} + {half.format('b')})
               FROM (SELECT unnest({p}) AS a, unnest({q}) AS b)) / 2, 0))"""


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.lang, d.t, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{Q.SYMBOLS}', '')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS own_lines,
         coalesce(n_repeat, 0) AS n_repeat_words, {_CLASS}, length(t) AS chars,
         list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS tokens
  FROM d JOIN w USING (doc_id) LEFT JOIN cov USING (doc_id)),
ref AS (
  SELECT lang, [{', '.join(f'sum(c{i}) / greatest(sum(chars), 1)' for i in range(_N))},
                (sum(chars) - sum({_KNOWN})) / greatest(sum(chars), 1)] AS classes, sum(len(tokens)) AS tokens
  FROM base GROUP BY lang),
uses AS (SELECT lang, x AS word, count(*) AS n FROM (SELECT lang, unnest(tokens) AS x FROM base) GROUP BY ALL),
top AS (SELECT * FROM uses QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {Q.COMMON_WORDS}),
lists AS (
  SELECT lang, list(word ORDER BY n DESC, word) AS words, list(n / greatest(tokens, 1) ORDER BY n DESC, word) AS shares
  FROM top JOIN ref USING (lang) GROUP BY lang),
own AS (
  SELECT doc_id, list(u / greatest(nt, 1) ORDER BY n DESC, word) AS shares
  FROM (SELECT b.doc_id, t.n, t.word, len(b.tokens) AS nt, len(list_filter(b.tokens, lambda x: x = t.word)) AS u
        FROM base b JOIN top t USING (lang)) GROUP BY doc_id),
dist AS (
  SELECT base.*, {_distance('[' + ', '.join(f'c{i} / greatest(chars, 1)' for i in range(_N)) + f', (chars - ({_KNOWN})) / greatest(chars, 1)]', 'ref.classes')} AS class_distance,
         {_distance('list_append(coalesce(own.shares, []), 1 - coalesce(list_sum(own.shares), 0))', 'list_append(coalesce(lists.shares, []), 1 - coalesce(list_sum(lists.shares), 0))')} AS word_distance
  FROM base JOIN ref USING (lang) LEFT JOIN lists USING (lang) LEFT JOIN own USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, lines - own_lines AS n_dup_lines, n_repeat_words,
       n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.REPEATED_PERCENT} * n_words)
       AND NOT (chars >= {Q.MIN_CHARS} AND class_distance > {Q.CLASS_LIMIT})
       AND NOT (len(tokens) >= {Q.MIN_JUDGED} AND word_distance > {Q.WORD_LIMIT}) AS kept
FROM dist"""
