"""SQL of the prefix trie: rebuilt conversations as lists of turns, nodes as their prefixes."""

#: CRC-32 of a decimal number, whose table of 256 entries is worked out from the polynomial.
_CRC = """
    crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
    ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM ids, crc)"""

TRIE_SQL = f"""
    WITH {_CRC},
    t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    r AS (SELECT h.c, coalesce(b.l, [])[1:h.h] || t.l[h.h + 1:] AS l FROM h JOIN t ON t.c = h.c LEFT JOIN t b ON b.c = h.c - h.c % 20),
    p AS (SELECT c, len(l) AS n, d, l[1:d] AS k FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
    v AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(coalesce(k[d].text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM p GROUP BY d, k),
    u AS (SELECT v.*, par.conv_id AS parent_conv_id, (SELECT count(*) FROM v x WHERE x.d = v.d + 1 AND x.k[1:v.d] = v.k) AS n_children FROM v LEFT JOIN v par ON par.d = v.d - 1 AND par.k = v.k[1:v.d - 1])
    SELECT u.conv_id, u.d AS depth, u.parent_conv_id, u.n_convs, u.n_children, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.w)::BIGINT AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
    FROM u JOIN u x ON x.d >= u.d AND x.k[1:u.d] = u.k GROUP BY u.conv_id, u.d, u.k, u.parent_conv_id, u.n_convs, u.n_children, u.ends"""
