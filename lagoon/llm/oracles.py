"""SQL (DuckDB) for the operators that it can express."""

from __future__ import annotations

from lagoon.llm import quality

OP2 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def grams(n: int) -> str:
    """doc_id, key, i: the digest of every n consecutive words, and its place."""
    at = f"range(1, len(w) - {n - 2})"
    return f"SELECT doc_id, unnest(list_transform({at}, lambda i: md5(array_to_string(w[i:i + {n - 1}], ' ')))) AS key, unnest({at}) AS i FROM d WHERE len(w) >= {n}"


OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
k AS ({grams(50)}),
m AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN m USING (key) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _op8() -> str:
    shares, joins, parts, limits = [], [], [], []
    for n, limit in quality.NGRAM_LIMITS.items():
        parts.append(
            f"g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) > 1 AS again FROM ({grams(n)})), "
            f"c{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE again), "
            f"s{n} AS (SELECT doc_id, CAST(sum(size) AS DOUBLE) AS s{n} FROM c{n} JOIN x USING (doc_id, i) GROUP BY doc_id)"
        )
        joins.append(f"LEFT JOIN s{n} USING (doc_id)")
        shares.append(f"coalesce(s{n} / word_chars, 0)")
        limits.append(f"coalesce(s{n} / word_chars, 0) / CAST({limit} AS DOUBLE)")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(list_transform(w, lambda y: length(y))) AS size, unnest(range(1, len(w) + 1)) AS i FROM d),
{", ".join(parts)},
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) > 1 AS again FROM ({grams(3)})),
r3 AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM g3 WHERE again) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
a AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS DOUBLE) AS dup_chars FROM a WHERE again GROUP BY doc_id),
e AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  greatest({", ".join(shares)}) AS coverage, greatest({", ".join(limits)}) AS worst, coalesce(dup_chars / word_chars, 0) AS line_coverage,
  n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM e LEFT JOIN b USING (doc_id) LEFT JOIN r3 USING (doc_id) {" ".join(joins)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coverage, line_coverage, base_failed,
  NOT base_failed AND worst <= 1 AND line_coverage <= CAST({quality.LINE_LIMIT} AS DOUBLE) AND n_symbols <= CAST({quality.SYMBOL_LIMIT} AS DOUBLE) * n_words AS kept FROM f
"""


OP8 = _op8()
