"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from .licences import TEMPLATES
from .mixing_sql import OP11

CONTROL = "</s>[INST] ok [/INST]"
WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT row_id, s, p.n, item_id FROM (SELECT row_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM places) p JOIN wins USING (win)),
covered AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY 1),
items AS (SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN items USING (row_id)"""


def escaped_length(c: str) -> str:
    return rf"length(regexp_replace(replace({c}, '~', '~0'), '[<\[](\||/?s>|/?INST\]|</?SYS>>)', '\0~1', 'g'))"


OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|im_start|>') + {escaped_length('role')} + 1 + {escaped_length('text')} + length('<|im_end|>') + 1) AS size FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN parts USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""

LISTED = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
OP4 = f"""
WITH t(template, license, text) AS (VALUES {LISTED}), n AS (SELECT template, license, w, len(w) AS n, CAST(ceil(len(w) / 4.0) AS BIGINT) AS stride, least(5, len(w)) AS k FROM (SELECT template, license, {WORDS} AS w FROM t)),
want AS (SELECT DISTINCT template, license, n, stride, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS shingle FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM n)),
sizes AS (SELECT template, count(*) AS size FROM want GROUP BY 1), ks AS (SELECT DISTINCT k FROM want),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS w FROM documents),
places AS (SELECT row_id, doc_id, k, p, len(w) AS words, array_to_string(list_slice(w, p + 1, p + k), ' ') AS shingle FROM (SELECT row_id, doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT row_id, doc_id, template, license, shingle, unnest(range(greatest(0, CAST(ceil((p + k - n - stride) / CAST(stride AS DOUBLE)) AS BIGINT)), p // stride + 1)) * stride AS first_word FROM places JOIN want USING (k, shingle)),
held AS (SELECT row_id, doc_id, template, license, first_word, count(DISTINCT shingle) / CAST(any_value(size) AS DOUBLE) AS containment FROM hits JOIN sizes USING (template) GROUP BY row_id, doc_id, template, license, first_word)
SELECT doc_id, license, max(containment) AS containment, CAST(min(first_word) AS INT) AS first_word, count(DISTINCT (first_word, template)) AS n_windows FROM held WHERE containment >= 0.8 GROUP BY doc_id, license"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {TERMS} AS w FROM documents), k AS (SELECT row_id, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
st AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM k),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(w) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT query, item_id, term FROM (SELECT row_number() OVER () AS query, item_id, unnest({TERMS}) AS term FROM benchmark)),
sc AS (SELECT query, item_id, row_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc) WHERE rank <= 10"""

def crc_table() -> list[int]:
    """The 256 remainders of the reversed polynomial 0xEDB88320, by which SQL reckons CRC-32 byte by byte."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


OP13 = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a >> 8, {crc_table()}[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, no, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND no <= h UNION ALL SELECT c.conv_id, no + 4, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND no > h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY no) AS d, md5(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, d, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, words FROM n UNION ALL SELECT conv_id, 0, '', 0 FROM c),
x AS (SELECT conv_id, d, key, words, lag(key) OVER w AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
g AS (SELECT key, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY key),
k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT p.key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * g.words) AS saved FROM g JOIN p ON p.conv_id = g.conv_id AND p.d <= g.depth LEFT JOIN k ON k.key = g.key GROUP BY 1)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN g u ON u.key = g.up"""

ORACLE = {"op13_prefix_trie": OP13, "op11_mix_sources": OP11, "op12_ranked_search": OP12, "op4_licences": OP4, "op2_decontaminate": OP2, "op8_chat_format": OP8, "op9_embeddings": OP9}
