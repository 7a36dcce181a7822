"""DuckDB SQL of the corpus queries that SQL can express."""

_PLUS = "printf('%08d', CAST({p}[1:8] AS INT) + {c}) || {p}[9:] || '{e}'"


def _plus(path: str, edit: str, cost: str | int) -> str:
    return _PLUS.format(p=path, c=cost, e=edit)


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_BEFORE = "least(s0, s1, i3)"

#: A path is its cost in eight digits and its edits, so that the lesser string is the better path; the checksum is worked out from its table.
OP12 = f"""WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT n.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS what FROM n, t),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 0 THEN [] WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, right(rtrim(text, {_BLANKS}), 1) AS last_char FROM d),
f AS (SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER w AS before, lag(turn) OVER w AS last_turn, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
c AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM c
UNION ALL SELECT conv_id, pos, {_plus('s0', 'D', 4)}, least({_plus('s1', 'D', 4)}, CASE WHEN whole AND initial = 's' THEN {_plus('s0', 'K', 'keep')} END),
 least({_plus('i2', 'D', 4)}, CASE WHEN whole AND initial = 'u' THEN {_plus(_BEFORE, 'K', 'keep')} END, CASE WHEN whole THEN {_plus(_BEFORE, 'R', 'keep + 3')} END),
 least({_plus('i3', 'D', 4)}, CASE WHEN whole AND initial = 'a' THEN {_plus('i2', 'K', 'keep')} END, CASE WHEN whole THEN {_plus('i2', 'R', 'keep + 3')} END)
 FROM (SELECT *, least(s3, {_plus('i2', 'I', 3)}) AS i3 FROM (SELECT p.conv_id, f.pos, f.initial, f.fault NOT IN ('blank', 'duplicate') AS whole, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS keep, s0, s1, s3, least(s2, {_plus('s0', 'I', 3)}, {_plus('s1', 'I', 3)}, {_plus('s3', 'I', 3)}) AS i2
 FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1))),
b AS (SELECT p.conv_id, least(s0, s3, {_plus('s2', 'I', 3)}, {_plus('s0', 'II', 6)}, {_plus('s1', 'II', 6)}) AS best FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos),
a AS (SELECT conv_id, best[9:] AS audit, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, true AS next_user, CAST([] AS VARCHAR[]) AS done FROM b
UNION ALL SELECT a.conv_id, audit, k + 1, a.pos + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN next_user WHEN e = 'K' AND f.initial = 's' THEN true ELSE NOT next_user END,
 CASE WHEN e = 'D' THEN done ELSE list_append(done, CASE WHEN e = 'K' THEN f.role WHEN next_user THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END) END
 FROM (SELECT *, audit[k + 1 : k + 1] AS e FROM a WHERE k < length(audit)) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.pos = a.pos + 1),
r AS (SELECT conv_id, sha256(array_to_string(done, chr(10))) AS sha FROM a WHERE k = length(audit))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:8] AS BIGINT), 0) AS cost, coalesce(best[9:], '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id"""
