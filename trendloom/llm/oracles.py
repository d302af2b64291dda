"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from trendloom.llm import credential_links as links

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM t WINDOW same AS (PARTITION BY content)
"""

# The random number of a document, its size and the binary length of the size.
MIX = r"""
WITH keyed AS (SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(doc_id::VARCHAR, 'null') || '#' || md5(coalesce(text, '')) || '#'
      || row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS key
  FROM documents),
sized AS (SELECT *, (('0x' || substr(md5(key || '#0'), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u FROM keyed),
docs AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM sized),
numbered AS (SELECT source, sum(size)::BIGINT AS source_size,
    list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::BIGINT AS weight
  FROM docs GROUP BY source),
a AS (SELECT *, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM numbered),
b AS (SELECT *, sum(most) OVER upto + most / weight * coalesce(sum(weight) OVER aft, 0) <= budget AS is_full FROM a
  WINDOW upto AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING),
    aft AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE
    (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0.0::DOUBLE))
      / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM b),
classes AS (SELECT source, bits, sum(size)::BIGINT AS words FROM docs WHERE bits > 0 GROUP BY source, bits),
c AS (SELECT k.*, t.source_size, t.target,
    sum(words) OVER longer * 2.0::DOUBLE + (2.0::DOUBLE / bits) * coalesce(sum(bits * words) OVER shorter, 0)
      <= t.target AS is_full
  FROM classes k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
  WINDOW longer AS (PARTITION BY k.source ORDER BY bits DESC ROWS UNBOUNDED PRECEDING),
    shorter AS (PARTITION BY k.source ORDER BY bits DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CASE WHEN is_full THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE,
    (target - coalesce(sum(CASE WHEN is_full THEN words END) OVER s, 0) * 2.0::DOUBLE)
      / sum(CASE WHEN NOT is_full THEN bits * words END) OVER s * bits) END AS copies
  FROM c WINDOW s AS (PARTITION BY source)),
plan AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p,
    target - sum(floor(copies) * words) OVER (PARTITION BY source) AS left_words FROM d),
ranked AS (SELECT x.doc_id, x.key, x.source, x.size, p.whole, p.left_words,
    CASE WHEN p.p > 0 THEN (x.u / (1 - x.u)) / (p.p / (1 - p.p)) END AS ratio
  FROM docs x LEFT JOIN plan p ON x.source IS NOT DISTINCT FROM p.source AND x.bits = p.bits),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source, ratio IS NULL
    ORDER BY ratio, key ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, t.source_size, t.target,
  ((coalesce(whole, 0) + CASE WHEN ratio IS NOT NULL AND upto - size < left_words
    AND upto - left_words <= left_words - (upto - size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (coalesce(whole, 0) + CASE WHEN ratio IS NOT NULL AND upto - size < left_words
    AND upto - left_words <= left_words - (upto - size) THEN 1 ELSE 0 END)::INT AS copies
FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""

HARD_NEGATIVES = r"""
WITH finite AS (SELECT * FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM finite),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

RANKED_SEARCH = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
wanted AS (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus GROUP BY term),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact
  FROM counts JOIN lengths USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""



def _secret_scan() -> str:
    """Spans of every kind by running sums of pieces, parts compared with all parts of their text."""
    kinds = {**links.BASE, **links.WEAK, "break": (links.BREAK, 0, 0)}
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS matches,"
        f" regexp_extract_all(text, p, {group}) AS vals, {least} AS least"
        f" FROM t, (SELECT '{pattern.replace(chr(39), chr(39) * 2)}' AS p)"
        for kind, (pattern, group, least) in kinds.items()
    )
    random_looking = " AND ".join(f"regexp_matches(value, '{form}')" for form in links.RANDOM)
    places = " ".join(f"WHEN '{kind}' THEN {place}" for place, kind in enumerate(links.KINDS))
    roles = " ".join(f"WHEN '{kind}' THEN '{role}'" for kind, role in links.ROLES.items())
    needs = " OR ".join(
        f"p.kind = '{kind}' AND " + " AND ".join(
            "EXISTS (SELECT 1 FROM parts o WHERE o.doc_id IS NOT DISTINCT FROM p.doc_id AND o.scope = p.scope"
            f" AND o.role = '{role}' AND abs(o.s - p.s) <= {links.REACH})"
            for role in needed
        )
        for kind, needed in links.NEEDS.items()
    )
    base = ", ".join(f"'{kind}'" for kind in links.BASE)
    span = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in links.BASE)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
pieces AS (SELECT doc_id, kind, least, unnest(range(1, len(matches) + 1)) AS i, unnest(gaps[:len(matches)]) AS gap,
  unnest(matches) AS m, unnest(vals) AS value FROM found WHERE len(matches) > 0),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM pieces),
spans AS (SELECT doc_id, kind, e - length(m) AS s, e FROM placed
  WHERE length(value) >= least AND (kind <> 'secret' OR {random_looking})),
parts AS (SELECT s.*, CASE kind {roles} END AS role, CASE kind {places} END AS place,
    (SELECT count(*) FROM spans b WHERE b.kind = 'break' AND b.doc_id IS NOT DISTINCT FROM s.doc_id AND b.s < s.s) AS scope
  FROM spans s WHERE kind IN ({base}) OR kind <> 'break' AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind IN ({base})
    AND b.doc_id IS NOT DISTINCT FROM s.doc_id AND b.s < s.e AND s.s < b.e)),
reported AS (SELECT * FROM parts p WHERE kind IN ({base}) OR {needs}),
listed AS (SELECT doc_id, {counts},
    string_agg({span}, ',' ORDER BY s, place) FILTER (kind IN ({base})) AS base,
    string_agg({span}, ',' ORDER BY s, place) AS spans FROM reported GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN listed l ON t.doc_id IS NOT DISTINCT FROM l.doc_id
"""


ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op6_mix_sources": MIX,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_secret_scan": _secret_scan(),
    "op13_ranked_search": RANKED_SEARCH,
}
