"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from repeatlens.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM words, (VALUES (1), (2), (3), (4)) lengths(k)
),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM runs GROUP BY ALL HAVING count(*) >= 30
),
cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut
  FROM counts WHERE k >= 2
),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r,
         ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1 : c.k], ' ')
),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
inner_runs AS (
  SELECT lang, a, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (
    SELECT lang, a, k, n, string_split(phrase, ' ') AS w, unnest(range(1, k - n + 2)) AS i
    FROM counts, (VALUES (2), (3)) lengths(n) WHERE n < k
  )
),
around AS (SELECT lang, phrase, max(a) AS around FROM inner_runs GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.around IS NULL OR 100::HUGEINT * o.around < 80::HUGEINT * b.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# crc32 of the decimal digits of an id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [ord(d)::BIGINT FOR d IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP13 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
said AS (
  SELECT conv_id, turn, {{'role': role, 'text': text}} AS what,
         sha256(strlen(role)::VARCHAR || ':' || role || text) AS tid
  FROM rows
),
originals AS (
  SELECT conv_id, list(what ORDER BY turn NULLS FIRST, tid) AS seq FROM said GROUP BY conv_id
),
taken AS (SELECT conv_id, seq, {_CRC} % 9 AS h FROM originals),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.seq[1 : c.h], []) || c.seq[c.h + 1 :] AS seq
  FROM taken c LEFT JOIN originals b ON b.conv_id = c.conv_id - c.conv_id % 5
),
members AS (
  SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
),
nodes AS (
  SELECT seq[1 : depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth)),
                  sha256('')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(seq[depth].text)) END AS bytes
  FROM members GROUP BY seq[1 : depth], depth
),
children AS (
  SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
),
family AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
),
upward AS (
  SELECT path, (n_convs - 1) * bytes AS saved, (n_children = 0)::BIGINT AS leaf,
         unnest(range(0, depth + 1)) AS up
  FROM family
),
subtrees AS (
  SELECT path[1 : up] AS path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
  FROM upward GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       s.n_leaves, s.saved_tokens, n.ends_sha256
FROM family n JOIN subtrees s USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1]
"""


def op11() -> str:
    """The scan with the templates of the query, block by block."""
    rows = ",\n    ".join(
        f"({k}, '{t.label}', {t.phrase}, {licenses.needed(t)}, {licenses.step_of(t)}, '{t.text}')"
        for k, t in enumerate(licenses.TEMPLATES)
    )
    return rf"""
WITH templates AS (
  SELECT *, string_split(text, ' ') AS run, list_distinct(string_split(text, ' ')) AS held FROM (VALUES
    {rows}
  ) t(id, label, phrase, need, step, text)
),
words AS (
  SELECT doc_id, row_number() OVER () AS row,
         list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
candidates AS (
  SELECT row, w, t.* EXCLUDE (run), t.run
  FROM words JOIN templates t ON len(list_intersect(w, t.held)) >= t.need
),
blocks AS (
  SELECT * EXCLUDE (w), w[start + 1 : start + 2 * step] AS b
  FROM (SELECT *, unnest(range(0, len(w), step)) AS start FROM candidates)
),
pairs AS (
  SELECT row, start, label, phrase, len(list_intersect(b, held)) AS common, len(held) AS n,
         CASE WHEN phrase THEN list_filter(range(0, step), lambda p: b[p + 1 : p + len(run)] = run)
         END AS places, need
  FROM blocks
),
hits AS (
  SELECT row, label, phrase, common / n AS containment, list_transform(places, lambda p: p + start) AS places
  FROM pairs WHERE common >= need AND (NOT phrase OR len(places) > 0)
),
found AS (
  SELECT row, sum(CASE WHEN phrase THEN len(places) ELSE 0 END)::BIGINT AS n_base,
         min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(containment) AS score
  FROM hits GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words LEFT JOIN found USING (row)
"""
