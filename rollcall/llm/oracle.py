"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
         translate(regexp_replace(u.line, '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), repeated AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, CAST(count(r.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.key IS NULL), ''))
         AS kept_sha256
FROM lines l LEFT JOIN repeated r USING (key)
GROUP BY l.doc_id"""

_WORDS13 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP5 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS13} AS w FROM documents),
items AS (SELECT item_id, {_WORDS13} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT d.doc_id, d.i, d.size, x.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
              FROM docs, sizes WHERE len(w) >= size)) d
  JOIN windows x ON x.size = d.size AND x.win = d.win),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)"""


_OP10 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i
        FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k
    FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b
  WHERE 100 * x.k >= 85 * (m.n + n.n - x.k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n"""


def _op11() -> str:
    def near(books: str) -> str:
        """Each part with its nearest entry."""
        return f"""
  SELECT vec_id, label, p, part, e, err FROM (
    SELECT x.vec_id, x.label, x.p, x.part, b.e,
           list_sum(list_transform(list_zip(x.part, b.entry),
                                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS err
    FROM parts x JOIN {books} b USING (p))
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY err, e) = 1"""

    def moved(near: str, books: str) -> str:
        return f"""
  SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM {books} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS entry FROM (
      SELECT p, e, i, CAST(floor(CAST(sum(part[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c
      FROM {near}, (SELECT unnest(generate_series(1, (SELECT max(len(part)) FROM parts))) AS i)
      GROUP BY p, e, i) GROUP BY p, e) m USING (p, e)"""

    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS part
  FROM kept, (SELECT unnest(generate_series(0, 15)) AS p)),
books0 AS (
  SELECT x.p, f.e, x.part AS entry FROM parts x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
    ORDER BY vec_id LIMIT 64) f USING (vec_id)),
near0 AS ({near("books0")}),
books1 AS ({moved("near0", "books0")}),
near1 AS ({near("books1")}),
books2 AS ({moved("near1", "books1")}),
near2 AS ({near("books2")}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
         CAST(sum(err) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM books2)
         AS codebooks_sha256
FROM coded"""


_OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 20 AS h
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE h <> 0)),
placed AS (
  SELECT *, row_number() OVER w AS p, lag(left(role, 1)) OVER w AS before, left(role, 1) AS ini,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS tail
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate'
                 WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS copy FROM placed)),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, {'c': 0, 'a': ''} AS b0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS b1,
         CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS b2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS b3
  FROM conversations
  UNION ALL
  SELECT conv_id, p, ADD(c0, 3, 'D'), LEAST2(ADD(c1, 3, 'D'), CASE WHEN free AND ini = 's' THEN ADD(c0, t, 'K') END),
         LEAST2(ADD(c2, 3, 'D'), CASE WHEN free THEN ADD(list_min([c0, c1, c3]), CASE ini WHEN 'u' THEN t ELSE 2 + t END,
                                                       CASE ini WHEN 'u' THEN 'K' ELSE 'R' END) END),
         LEAST2(ADD(c3, 3, 'D'), CASE WHEN free THEN ADD(c2, CASE ini WHEN 'a' THEN t ELSE 2 + t END,
                                                       CASE ini WHEN 'a' THEN 'K' ELSE 'R' END) END)
  FROM (SELECT f.conv_id, f.p, f.ini, f.fault NOT IN ('blank', 'duplicate') AS free,
               CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END AS t, w.b0 AS c0, w.b1 AS c1,
               list_min([w.b2, ADD(w.b0, 2, 'I'), ADD(w.b1, 2, 'I'), ADD(w.b3, 2, 'I')]) AS c2,
               list_min([w.b3, ADD(w.b2, 2, 'I'), ADD(w.b0, 4, 'II'), ADD(w.b1, 4, 'II')]) AS c3
        FROM walk w JOIN faults f ON f.conv_id = w.conv_id AND f.p = w.p + 1)),
ended AS (
  SELECT conv_id, best.c AS cost, best.a AS audit
  FROM (SELECT conv_id, list_min([b0, b3, ADD(b2, 2, 'I'), ADD(b1, 4, 'II')]) AS best, p,
               max(p) OVER (PARTITION BY conv_id) AS n FROM walk) WHERE p = n),
letters AS (
  SELECT conv_id, i, ch, count(*) FILTER (WHERE ch <> 'I') OVER w AS rown, count(*) FILTER (WHERE ch <> 'D') OVER w AS outn
  FROM (SELECT conv_id, i, audit[i] AS ch
        FROM (SELECT conv_id, audit, unnest(generate_series(1, length(audit))) AS i FROM ended))
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
lines AS (
  SELECT l.conv_id, l.outn, l.ch, f.role, f.text,
         max(CASE WHEN l.outn = 1 AND l.ch = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS off
  FROM letters l LEFT JOIN faults f ON f.conv_id = l.conv_id AND l.ch <> 'I' AND f.p = l.rown
  WHERE l.ch <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN ch = 'K' THEN role WHEN (outn - off) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE ch WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY outn) AS text
  FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(coalesce(r.text, '')) AS repaired_sha256
FROM ended e LEFT JOIN counts USING (conv_id) LEFT JOIN repaired r USING (conv_id)"""


def _op12() -> str:
    """The recursion's short forms written out."""
    out = _OP12
    while "ADD(" in out or "LEAST2(" in out:
        at = max(out.rfind("ADD("), out.rfind("LEAST2("))
        begin, depth, cuts = out.index("(", at) + 1, 0, []
        for end in range(begin, len(out)):
            depth += (out[end] in "([") - (out[end] in ")]")
            if depth < 0:
                break
            if out[end] == "," and depth == 0:
                cuts.append(end)
        parts = [out[a + 1:b].strip() for a, b in zip([begin - 1, *cuts], [*cuts, end])]
        full = (f"list_min([{', '.join(parts)}])" if out.startswith("LEAST2", at) else
                f"CASE WHEN {parts[0]} IS NOT NULL THEN {{'c': ({parts[0]}).c + {parts[1]}, "
                f"'a': ({parts[0]}).a || {parts[2]}}} END")
        out = out[:at] + full + out[end + 1:]
    return out


# a text is escaped only where it does not come back as it is: it holds a control
# string, or a backslash with a character after it
_OP13 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marks AS (
  SELECT *, (length(text) - length(replace(replace(text, '<|im_end|>', ''), '<|im_start|>', ''))
             - 2 * ((length(text) - length(replace(text, '<|im_start|>', ''))) // 12)) // 10 AS controls,
         length(text) - length(replace(text, '\', '')) AS slashes,
         regexp_matches(text, '(?s)\\.') AS taken
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(text) + controls + 11
                + CASE WHEN taken THEN slashes ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marks GROUP BY conv_id""".replace("\\\\", "\\")


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op5_decontam": _OP5, "op10_ngram_join": _OP10,
            "op11_vector_codes": _op11(), "op12_conversation_repair": _op12(),
            "op13_chat_format": _OP13}
