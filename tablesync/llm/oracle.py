"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: str) -> str:
    return f"translate(trim({line}, {_SPACES}), '{_UPPER}', '{_LOWER}')"


_CONTROL = r"(<s>|</s>|\[/?ROLE\]|\[/?INST\]|<</?SYS>>|<\|(?:im_start|im_end|endoftext|eot_id)\|>)"

OP5 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(role, '{_CONTROL}', '\\\1', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g'))
      + {len("<s>[ROLE]" + " [/ROLE] " + " </s>")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n
  FROM (SELECT doc_id, i, w[i : i + 2] AS win
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words))
),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
),
lines AS (
  SELECT doc_id, source, pos, {_key("s[pos]")} AS key, s[pos] AS line FROM (
    SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS pos FROM (
      SELECT doc_id, source, string_split(text, chr(10)) AS s FROM d))
  WHERE regexp_matches(s[pos], '[^\x20\x09-\x0D]')
),
bodies AS (SELECT doc_id, string_agg(key, chr(10) ORDER BY pos) AS body FROM lines GROUP BY doc_id),
limited AS (
  SELECT source, key FROM lines JOIN bodies USING (doc_id) GROUP BY source, key HAVING count(DISTINCT body) > 20
),
gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n
  FROM lines JOIN limited ON lines.key = limited.key AND lines.source IS NOT DISTINCT FROM limited.source
  GROUP BY doc_id
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.n, 0) AS gone
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - gone) >= 30 * n_words AS kept
FROM base
"""

OP9 = rf"""
WITH lines AS (
  SELECT doc_id, pos, s[pos] AS line, {_key("s[pos]")} AS key FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT lines.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE = {"op5_reply_trees": OP5, "op7_line_frequency": OP7, "op9_line_dedup": OP9}

# CRC-32 of an ASCII text, bit by bit: 3988292384 is the reversed polynomial EDB88320.
_CRC = """xor(4294967295, list_reduce(
    list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
    4294967295::BIGINT))"""


def _spelled(*values: str) -> str:
    return " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values)


_FIELDS = ("doc_id", "source", "lang", "n_chars")
ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE given AS (
    SELECT doc_id, source, sha256({_spelled(*_FIELDS, "text")}) AS leaf,
           sha256({_spelled(*_FIELDS, f"(CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS claim
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           count(*) OVER (PARTITION BY source) AS n
    FROM given),
lower_tree(source, l, i, h, n) AS (
    SELECT source, 0, i, leaf, n FROM leaves
    UNION ALL
    SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
    FROM lower_tree WHERE n > 1 GROUP BY source, l, i // 3, n),
subroots AS (
    SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS m
    FROM lower_tree WHERE n = 1),
upper_tree(l, i, h, n) AS (
    SELECT 0, j, subroot, m FROM subroots
    UNION ALL
    SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
    FROM upper_tree WHERE n > 1 GROUP BY l, i // 3, n),
lower_runs AS (SELECT source, l, i // 3 AS run, list(h ORDER BY i) AS hs FROM lower_tree WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT l, i // 3 AS run, list(h ORDER BY i) AS hs FROM upper_tree WHERE n > 1 GROUP BY ALL),
steps AS (
    SELECT v.source, v.i, 0 AS part, r.l, hs, (v.i // (3 ** r.l)::BIGINT) % 3 AS pos
    FROM leaves v JOIN lower_runs r ON v.source IS NOT DISTINCT FROM r.source AND r.run = v.i // (3 ** (r.l + 1))::BIGINT
    UNION ALL
    SELECT v.source, v.i, 1, r.l, hs, (s.j // (3 ** r.l)::BIGINT) % 3
    FROM leaves v JOIN subroots s ON v.source IS NOT DISTINCT FROM s.source
    JOIN upper_runs r ON r.run = s.j // (3 ** (r.l + 1))::BIGINT),
paths AS (
    SELECT source, i, list({{'l': array_to_string(list_slice(hs, 1, pos), ''), 'r': array_to_string(list_slice(hs, pos + 2, 3), ''), 'h': ''}}
                           ORDER BY part, l) AS path
    FROM steps GROUP BY source, i),
proved AS (
    SELECT v.doc_id, v.leaf, v.claim, s.subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root,
           coalesce(p.path, []) AS path
    FROM leaves v JOIN subroots s ON v.source IS NOT DISTINCT FROM s.source
    LEFT JOIN paths p ON v.source IS NOT DISTINCT FROM p.source AND v.i = p.i),
done AS (
    SELECT *, list_reduce(path, lambda a, s: {{'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}},
                          {{'l': '', 'r': '', 'h': claim}}).h AS folded_root
    FROM proved)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM done"""

ORACLE["op13_prefix_trie"] = f"""
WITH given AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS b, {_CRC.format("c::VARCHAR")} % 9 AS h, count(*) AS n FROM given GROUP BY c),
sized AS (SELECT v.c, v.b, v.h, least(v.h, coalesce(g.n, 0)) AS taken FROM convs v LEFT JOIN convs g ON g.c = v.b),
turns AS (
    SELECT s.c, g.i AS d, role, text FROM sized s JOIN given g ON g.c = s.b AND g.i <= s.h
    UNION ALL
    SELECT s.c, g.i - s.h + s.taken, role, text FROM sized s JOIN given g ON g.c = s.c WHERE g.i > s.h),
prefixes AS (
    SELECT c, d, strlen(text) AS bytes,
           sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '')
                  OVER (PARTITION BY c ORDER BY d)) AS p
    FROM turns
    UNION ALL SELECT c, 0, 0, '' FROM convs),
placed AS (
    SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS before, d = max(d) OVER (PARTITION BY c) AS last FROM prefixes),
nodes AS (
    SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, max(before) AS before,
           string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends
    FROM placed GROUP BY d, p),
children AS (SELECT d - 1 AS d, before AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
family AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.d = n.d AND k.p = n.p),
below AS (
    SELECT a.d, a.p, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
    FROM family f JOIN prefixes a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.d, a.p)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
       b.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM family f JOIN below b ON b.d = f.d AND b.p = f.p
LEFT JOIN nodes up ON up.d = f.d - 1 AND up.p = f.before"""
