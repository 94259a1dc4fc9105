"""SQL of the queries that SQL can express."""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT r, r AS m FROM d UNION SELECT t.r, e.y FROM t JOIN e ON t.m = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON d.r = n.r JOIN t ON t.r = d.r JOIN d o ON o.r = t.m GROUP BY d.r, d.doc_id, n.n
"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
s AS (SELECT r, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
x AS (SELECT DISTINCT r, i + o AS p FROM s CROSS JOIN range(35) v(o)),
k AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.r = u.r AND x.p = u.p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(24 + length(role) + 5 * len(regexp_extract_all(role, '\n')) + len(regexp_extract_all(role, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols,
         ((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln(u) / greatest(0.05, CASE WHEN size + 4 * symbols = 0 THEN 1.0::DOUBLE ELSE size::DOUBLE / (size + 4 * symbols)::DOUBLE END) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3.0::DOUBLE, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, least(cap, coalesce(m.level * weight, cap)) AS target FROM w CROSS JOIN m),
e AS (
  SELECT source, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size)::BIGINT END AS epochs,
         floor(target)::BIGINT - CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size)::BIGINT END * source_size AS rest
  FROM t),
g AS (SELECT source, key, size, count(*) AS n FROM k GROUP BY source, key, size),
r AS (
  SELECT source, key, size, n, sum(n * size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - n * size AS start FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (e.epochs * k.size + CASE WHEN e.rest >= r.start + r.n * r.size THEN k.size WHEN e.rest > r.start THEN floor((e.rest - r.start) / r.n)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM k
JOIN e ON k.source IS NOT DISTINCT FROM e.source
JOIN r ON k.source IS NOT DISTINCT FROM r.source AND k.key = r.key AND k.size = r.size
"""

RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM d),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
b AS (SELECT r, gram FROM g GROUP BY r, gram HAVING count(*) >= 2),
c AS (
  SELECT r, count(DISTINCT i + o) AS n FROM g JOIN b USING (r, gram) CROSS JOIN (VALUES (0), (1), (2)) v(o) GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
         (length(bare) - length(regexp_replace(bare, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (length(bare) - length(regexp_replace(bare, '[A-Z]+', '', 'g')))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f
"""

_NAMES = ("few_words", "repeated_words", "symbol_heavy", "repeated_lines", "short_or_long_words", "capitals")
ABLATION_SQL = "WITH l AS (SELECT failed_bits AS b FROM (" + RULES_SQL + ")) " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ((b >> {i}) & 1 = 1) AS failed, count(*) FILTER (b = {1 << i}) AS removed_by_it_alone FROM l" for i, name in enumerate(_NAMES)
)

COPIES_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS place FROM d)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM n
"""


def merkle_sql(levels: int = 8, top: int = 3) -> str:
    """SQL of the Merkle manifest for up to 16^levels rows a source and 16^top sources: a table of runs for each level."""
    fields = ["CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END", *(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("source", "lang", "n_chars"))]
    text = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    eight = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {eight}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS k, {' || '.join(fields)} AS f, text, coalesce({crc} % 5 = 0, false) AS t FROM documents)",
        f"e AS (SELECT doc_id, k, sha256(f || {text.format('text')}) AS leaf, CASE WHEN t THEN sha256(f || {text.format(lower)}) ELSE sha256(f || {text.format('text')}) END AS forged FROM d)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM e)",
        "n0 AS (SELECT k, slot, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM s0)",
    ]
    for tree, depth in (("", levels), ("t", top)):
        if tree:
            parts.append(f"tn0 AS (SELECT '' AS k, k AS source, row_number() OVER (ORDER BY k) - 1 AS slot, h, count(*) OVER () AS n FROM n{levels})")
        for j in range(depth):
            parts.append(f"{tree}r{j} AS (SELECT k, n, slot // 16 AS run, list(h ORDER BY slot) AS m FROM {tree}n{j} GROUP BY ALL)")
            parts.append(f"{tree}n{j + 1} AS (SELECT k, run AS slot, CASE WHEN n = 1 THEN m[1] ELSE sha256(array_to_string(m, '')) END AS h, (n + 15) // 16 AS n FROM {tree}r{j})")
    joins, sides = [], []
    for tree, depth in (("", levels), ("t", top)):
        row = "tn0" if tree else "s0"
        for j in range(depth):
            run, place = f"{tree}r{j}", f"({row}.slot // {16**j})"
            joins.append(f"JOIN {run} ON {run}.run = {place} // 16" + ("" if tree else f" AND {run}.k = s0.k"))
            sides.append((f"CASE WHEN {run}.n = 1 THEN NULL ELSE array_to_string({run}.m[1:{place} % 16], '') END", f"array_to_string({run}.m[{place} % 16 + 2:], '')"))
    columns = ", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b) in enumerate(sides))
    parts.append(f"p AS (SELECT s0.doc_id, s0.leaf, s0.forged, tn0.h AS subroot, tn{top}.h AS root, {columns} FROM s0 JOIN tn0 ON tn0.source = s0.k {' '.join(joins)} CROSS JOIN tn{top})")
    parts.append("f0 AS (SELECT *, forged AS x, '' AS proof FROM p)")
    for i in range(len(sides)):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN a{i} IS NULL THEN x ELSE sha256(a{i} || x || b{i}) END AS x, CASE WHEN a{i} IS NULL THEN proof ELSE proof || a{i} || b{i} END AS proof) FROM f{i})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{len(sides)}"


MERKLE_SQL = merkle_sql()
