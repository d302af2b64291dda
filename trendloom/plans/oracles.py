"""The same queries as SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from trendloom.fixed_values import (
    CATEGORY_NAMES,
    DOMAIN_STOP_WORDS,
    ENGLISH_STOP_WORDS,
    PHRASE_STOP_WORDS,
    RELATION_COMMANDS,
    STYLE_WORDS,
)
from trendloom.plans import fixtures as fx

SPACE = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
SMALL_VOCABULARY = 500
SMALL_RESERVOIR = 40
SMALL_SAMPLE = 100

CORPUS = f"fx_corpus AS ({fx.oracle_view(fx.CORPUS)})"
LATEX = f"fx_latex AS ({fx.oracle_view(fx.LATEX)})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str) -> str:
    # Adding zero turns a negative zero into zero.
    return f"(round({expression}, 6) + 0.0)"


def r9(expression: str) -> str:
    return f"(round({expression}, 9) + 0.0)"


# ---- cleaning ----------------------------------------------------------------


def strip(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SPACE}+', ' ', 'g'))"


def relations(e: str) -> str:
    for command, words in RELATION_COMMANDS:
        e = f"replace({e}, {quoted(command)}, {quoted(words)})"
    return e


def commands(e: str) -> str:
    return rf"regexp_replace({e}, '\\([a-zA-Z]+)', '\1', 'g')"


def styles(e: str) -> str:
    return rf"regexp_replace({e}, '(?i)\b(?:{'|'.join(STYLE_WORDS)})\b', ' ', 'g')"


def scripts(e: str) -> str:
    return f"translate({e}, '{{}}_^', '    ')"


def powers(e: str) -> str:
    return rf"regexp_replace({e}, '\b[x×]\s*10\s*\(\s*(-?\d+)\s*\)', 'e\1', 'g')"


def blocks(e: str) -> str:
    inside = collapse(styles(scripts(commands(relations("p")))))
    for pattern in (r"\${1,2}([^$]+)\${1,2}", r"\\\(([^)]+)\\\)", r"\\\[(.*?)\\"):
        marked = rf"regexp_replace({e}, '{pattern}', chr(1) || '\1' || chr(1), 'g')"
        e = (
            f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p, i: "
            f"CASE WHEN i % 2 = 0 THEN ' ' || {inside} || ' ' ELSE p END), '')"
        )
    return e


def clean(e: str) -> str:
    e = blocks(relations(strip(e)))
    return collapse(powers(scripts(styles(commands(e)))))


def weighted(title: str, abstract: str) -> str:
    return collapse(f"{title} || '. ' || {title} || '. ' || {abstract}")


YEAR = "cast(year(strptime(nullif(update_date, ''), '%Y-%m-%d')) AS int)"
CLEANED = f"""
WITH {LATEX}, cleaned AS (
  SELECT id, {clean('title')} AS title, {clean('abstract')} AS abstract, {YEAR} AS update_year
  FROM fx_latex)
SELECT id, {fx.CATEGORIES} AS categories, {weighted('title', 'abstract')} AS text, update_year FROM cleaned
"""

# ---- text --------------------------------------------------------------------

N_WORDS = f"len(regexp_split_to_array({strip('text')}, '{SPACE}+'))"
FILTERED = f"docs AS (SELECT * FROM fx_corpus WHERE {strip('text')} <> '' AND {N_WORDS} >= 20)"


def letter_tokens(text: str) -> str:
    """Every non-ASCII letter becomes a digit, so that ASCII word borders suffice."""
    e = f"strip_accents(lower({text}))"
    e = rf"regexp_replace({e}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g')"
    e = rf"regexp_replace({e}, '[^\x00-\x7F]', '0', 'g')"
    return rf"regexp_extract_all({e}, '\b[a-z][a-z\-]+\b')"


def word_tokens(text: str) -> str:
    """Runs of word characters and hyphens hold one token at most."""
    runs = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_\-]+')"
    inner = r"regexp_extract(rtrim(run, '-'), '(?:^|-)([a-z][\p{L}\p{N}_\-]+)$', 1)"
    return f"list_filter(list_transform({runs}, lambda run: {inner}), lambda token: token <> '')"


def without(tokens: str, words) -> str:
    inside = ", ".join(quoted(word) for word in words)
    return f"list_filter({tokens}, lambda token: token NOT IN ({inside}))"


LETTER_STOP = ENGLISH_STOP_WORDS + DOMAIN_STOP_WORDS
PAIRS = "list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])"
TRIPLES = (
    "list_transform(range(1, len(toks) - 1), "
    "lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])"
)


def positions(tokens: str, name: str, source: str = "documents") -> str:
    return f"""
SELECT doc_id, cast(pos - 1 AS int) AS pos, l[pos] AS {name}
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos
      FROM (SELECT doc_id, {tokens} AS l FROM {source}))
"""


def counts(source: str, key: str, name: str) -> str:
    toks = without(letter_tokens("text"), LETTER_STOP)
    return f"""{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(toks, {PAIRS})) AS term
    FROM (SELECT {key}, {toks} AS toks FROM {source}))
  GROUP BY {key}, term)"""


def vocab(cap: int | None) -> str:
    limit = "" if cap is None else f"ORDER BY cf DESC, term LIMIT {cap}"
    return f"""vocab AS (
  SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS cf FROM counts GROUP BY term),
    (SELECT count(*) AS n FROM docs)
  WHERE df >= 5 AND df <= 0.8 * n {limit})"""


def weights(counted: str, key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, term, (1.0 + ln(tf)) * idf AS w FROM {counted} JOIN vocab USING (term)))"""


FIT = f"WITH {CORPUS}, {FILTERED}, {counts('docs', 'doc_id', 'counts')}, {vocab(None)}"
TFIDF = f"{FIT}, {weights('counts', 'doc_id', 'tfidf')}"

# ---- vectors -----------------------------------------------------------------

LONG = """vectors AS (SELECT vec_id, label AS cluster, cast(embedding AS double[]) AS v
  FROM embeddings),
long AS (SELECT vec_id, cluster, unnest(range(0, len(v))) AS component, unnest(v) AS value
  FROM vectors),
norms AS (SELECT vec_id, sqrt(sum(value * value)) AS norm FROM long GROUP BY vec_id),
unit AS (SELECT vec_id, cluster, component,
    CASE WHEN norm > 0 THEN value / norm ELSE value END AS value
  FROM long JOIN norms USING (vec_id)),
unit_rows AS (SELECT vec_id, cluster, list(value ORDER BY component) AS u
  FROM unit GROUP BY vec_id, cluster)"""
CENTERS = """centers AS (
  SELECT cluster, list(value ORDER BY component) AS center FROM (
    SELECT cluster, component, avg(value) AS value FROM long GROUP BY cluster, component)
  GROUP BY cluster)"""
NEAREST = """near AS (
  SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, v, centers.cluster AS c,
      list_sum(list_transform(list_zip(v, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM vectors, centers)
  GROUP BY vec_id, v)"""
CELLS = f"""ranked AS (
  SELECT vec_id, u, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS rank FROM (
    SELECT vec_id, u, centers.cluster AS cell,
      {r9('list_dot_product(center, center) - 2 * list_dot_product(u, center)')} AS d
    FROM unit_rows, centers))"""


def dealt_centers(rows: str, sizes=(3, 5, 7), name: str = "m0") -> str:
    """(model, cluster, center): means of the rows (vec_id, v) by the remainder of the id."""
    return f"""{name} AS (SELECT model, cluster, list(value ORDER BY component) AS center FROM (
      SELECT model, cluster, component, avg(value) AS value FROM (
        SELECT i AS model, vec_id % k AS cluster, unnest(range(0, len(v))) AS component, unnest(v) AS value
        FROM {rows}, (SELECT unnest(range(0, {len(sizes)})) AS i, unnest({list(sizes)}) AS k))
      GROUP BY model, cluster, component) GROUP BY model, cluster)"""


def nearest_center(rows: str, centers: str, name: str) -> str:
    """(model, vec_id, v, cluster, d): every row with its nearest centre of each model."""
    return f"""{name} AS (SELECT * FROM (SELECT c.model, r.vec_id, r.v, c.cluster,
      list_sum(list_transform(list_zip(v, center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
      FROM {rows} r, {centers} c) QUALIFY row_number() OVER (PARTITION BY model, vec_id ORDER BY d, cluster) = 1)"""


def mean_center(near: str, before: str, name: str) -> str:
    """The means of the rows of each centre; a centre without rows stays."""
    return f"""{name} AS (SELECT b.model, b.cluster, coalesce(n.center, b.center) AS center FROM {before} b LEFT JOIN (
      SELECT model, cluster, list(value ORDER BY component) AS center FROM (
        SELECT model, cluster, component, avg(value) AS value FROM (
          SELECT model, cluster, unnest(range(0, len(v))) AS component, unnest(v) AS value FROM {near})
        GROUP BY model, cluster, component) GROUP BY model, cluster) n USING (model, cluster))"""


def batch_center(near: str, before: str, name: str) -> str:
    """(model, cluster, center, seen): centres moved by the share of a batch in what they have seen."""
    return f"""{name} AS (SELECT b.model, b.cluster, b.seen + coalesce(n.n, 0) AS seen, CASE WHEN n.n IS NULL THEN b.center
      ELSE list_transform(list_zip(b.center, n.total), lambda p: p[1] + (p[2] - n.n * p[1]) / (b.seen + n.n)) END AS center
      FROM {before} b LEFT JOIN (
        SELECT model, cluster, any_value(n) AS n, list(value ORDER BY component) AS total FROM (
          SELECT model, cluster, component, sum(value) AS value, count(*) AS n FROM (
            SELECT model, cluster, unnest(range(0, len(v))) AS component, unnest(v) AS value FROM {near})
          GROUP BY model, cluster, component) GROUP BY model, cluster) n USING (model, cluster))"""


def model_rows(near: str, centers: str) -> str:
    """Centres of all models with the numbers of their rows and the models' costs, by component."""
    return f"""SELECT cast(model AS int) AS model, cast(cluster AS int) AS cluster, coalesce(n, 0) AS n,
        {r6('cost')} AS cost, cast(component AS int) AS component, {r6('value')} AS value
      FROM (SELECT model, cluster, unnest(range(0, len(center))) AS component, unnest(center) AS value FROM {centers})
      JOIN (SELECT model, sum(d) AS cost FROM {near} GROUP BY model) USING (model)
      LEFT JOIN (SELECT model, cluster, count(*) AS n FROM {near} GROUP BY model, cluster) USING (model, cluster)"""


BATCH = "cast(concat('0x', substr(md5(concat(cast(vec_id AS varchar), '#0')), 1, 8)) AS bigint) % 2"
TWO_STEPS = ", ".join([
    dealt_centers("vectors"), nearest_center("vectors", "m0", "n0"), mean_center("n0", "m0", "m1"),
    nearest_center("vectors", "m1", "n1"), mean_center("n1", "m1", "m2"), nearest_center("vectors", "m2", "n2"),
])
PLACES = """places AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y
  FROM embeddings),
forth AS (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE / step AS weight
  FROM places a, (SELECT unnest(range(1, 6)) AS step) JOIN places b ON b.id = a.id + step),
edges AS (SELECT * FROM forth UNION ALL SELECT dst, src, weight FROM forth)"""
CENTROIDS = """centroids AS (
  SELECT cluster, component, avg(value) AS value, count(*) AS n FROM unit
  GROUP BY cluster, component)"""
SIMILARITY = """cand AS (
  SELECT cast(vec_id % 41 AS int) AS cand_id, component, avg(value) AS value FROM long
  GROUP BY vec_id % 41, component),
likeness AS (
  SELECT cluster, cand_id, CASE WHEN sum(a.value * a.value) * sum(b.value * b.value) = 0 THEN 0
      ELSE sum(a.value * b.value) / sqrt(sum(a.value * a.value)) / sqrt(sum(b.value * b.value))
    END AS similarity
  FROM centroids a JOIN cand b USING (component) GROUP BY cluster, cand_id)"""

TOP_TERMS = f"""{FIT}, {LONG}, {CENTROIDS},
factors AS (
  SELECT term, j - 1 AS component,
    (length(term) * j + df * (j % 5) + cf * (j % 3)) % 11 - 5 AS value
  FROM (SELECT *, unnest(range(1, 65)) AS j FROM vocab)),
mapped AS (
  SELECT cluster, term, {r9('sum(a.value * b.value)')} AS weight
  FROM centroids a JOIN factors b USING (component) GROUP BY cluster, term),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS place
  FROM mapped),
top_terms AS (
  SELECT cluster, string_agg(term, ', ' ORDER BY place) AS top_terms
  FROM placed WHERE place <= 12 GROUP BY cluster)"""

# ---- labels ------------------------------------------------------------------

LONG_TEXTS = f"""long_texts AS (
  SELECT id, cluster, {strip('text')} AS text FROM fx_corpus
  WHERE id IS NOT NULL AND cluster IS NOT NULL AND length({strip('text')}) >= 120)"""

NAMES = "names(code, name) AS (VALUES " + ", ".join(
    f"({quoted(code)}, {quoted(name)})" for code, name in CATEGORY_NAMES.items()
) + ")"
CODES = r"regexp_extract_all(coalesce(categories, ''), '[A-Za-z\-]+(?:\.[A-Za-z\-]+)?')"
CODE_COUNTS = f"""code_counts AS (
  SELECT cluster, codes, n, cast(sum(n) OVER (PARTITION BY cluster) AS bigint) AS cluster_total,
    n / sum(n) OVER (PARTITION BY cluster) AS share
  FROM (SELECT cluster, codes, count(*) AS n
        FROM (SELECT cluster, unnest({CODES}) AS codes FROM fx_corpus)
        GROUP BY cluster, codes))"""
TOP_CODES = """top_codes AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, codes) AS place FROM (
    SELECT *, max(CASE WHEN share >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster) AS any_ok
    FROM code_counts)
  WHERE share >= 0.05 OR any_ok = 0
  QUALIFY place <= 3)"""


def shortened(e: str, limit: int) -> str:
    return f"CASE WHEN length({e}) > {limit} THEN left({e}, {limit - 1}) || '…' ELSE {e} END"


CODE_LABELS = f"""label_lists AS (
  SELECT cluster, string_agg(coalesce(name, codes), ', ' ORDER BY place) AS names,
    string_agg(codes || ' — ' || coalesce(name, codes), ', ' ORDER BY place) AS both_names,
    string_agg(codes, ', ' ORDER BY place) AS codes
  FROM top_codes LEFT JOIN names ON codes = code GROUP BY cluster),
code_labels AS (
  SELECT cluster, {shortened('names', 80)} AS label_auto, {shortened('both_names', 120)} AS label_alt,
    codes AS top_codes, names AS top_names
  FROM label_lists)"""
LABELLED = f"{NAMES}, {CODE_COUNTS}, {TOP_CODES}, {CODE_LABELS}"

PHRASE_TOKENS = without(word_tokens("text"), ENGLISH_STOP_WORDS)
# Four texts share an id, which has one cluster; some have none.
SHARED_IDS = f"""fx_base AS ({fx.oracle_view(fx.CORPUS)}),
fx_shared AS (SELECT CASE WHEN doc_id % 29 = 0 THEN NULL ELSE concat('s', doc_id // 4) END AS id,
  doc_id, text, cluster FROM fx_base),
fx_corpus AS (SELECT id, text, l.cluster FROM fx_shared JOIN (
  SELECT id, arg_max(cluster, doc_id) AS cluster FROM fx_shared GROUP BY id) l USING (id))"""


def phrases(corpus: str) -> str:
    """Key phrases; every line is vectorised by itself, whatever its id."""
    return f"""
WITH {corpus}, {LONG_TEXTS},
docs AS (
  SELECT *, row_number() OVER () AS line FROM long_texts
  QUALIFY row_number() OVER (PARTITION BY cluster, text ORDER BY id) = 1),
sizes AS (SELECT cluster, count(*) AS n FROM docs GROUP BY cluster),
counts AS (
  SELECT cluster, line, term, count(*) AS tf FROM (
    SELECT cluster, line, unnest(list_concat({PAIRS}, {TRIPLES})) AS term
    FROM (SELECT cluster, line, {PHRASE_TOKENS} AS toks FROM docs))
  GROUP BY cluster, line, term),
vocab AS (
  SELECT cluster, term, n, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT cluster, term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY cluster, term)
  JOIN sizes USING (cluster)
  WHERE df >= 5 AND df <= 0.5 * n),
weighted AS (
  SELECT cluster, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY line)) AS weight
  FROM (SELECT cluster, line, term, n, (1.0 + ln(tf)) * idf AS w
        FROM counts JOIN vocab USING (cluster, term))),
means AS (
  SELECT cluster, term, {r9('sum(weight) / max(n)')} AS weight FROM weighted
  GROUP BY cluster, term),
best AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS place,
    NOT list_has_any(string_split(lower(term), ' '),
      [{', '.join(quoted(word) for word in PHRASE_STOP_WORDS)}]) AS clean
  FROM means QUALIFY place <= 10),
kept AS (
  SELECT * FROM best QUALIFY clean OR NOT bool_or(clean) OVER (PARTITION BY cluster))
SELECT cast(c.cluster AS int) AS cluster,
  coalesce(string_agg(term, ', ' ORDER BY place), '') AS key_phrases
FROM (SELECT unnest(range(0, (SELECT max(cluster) + 1 FROM fx_corpus))) AS cluster) c
LEFT JOIN kept ON kept.cluster = c.cluster GROUP BY c.cluster
"""

# ---- trends ------------------------------------------------------------------

SHARE = """share AS (
  SELECT update_year, cluster, n, n / sum(n) OVER (PARTITION BY update_year) AS share
  FROM (SELECT update_year, cluster, count(*) AS n FROM fx_corpus
        WHERE update_year IS NOT NULL AND cluster IS NOT NULL GROUP BY update_year, cluster)),
grid AS (
  SELECT y.update_year, c.cluster, coalesce(s.share, 0.0) AS share
  FROM (SELECT DISTINCT update_year FROM share) y CROSS JOIN
    (SELECT DISTINCT cluster FROM share) c
  LEFT JOIN share s ON s.update_year = y.update_year AND s.cluster = c.cluster)"""


def ranking(score: str, top: int, where: str = "true") -> str:
    return f"""best AS (
  SELECT cluster, {r9(score)} AS score FROM grid WHERE {where} GROUP BY cluster
  ORDER BY score DESC, cluster LIMIT {top}),
ranked AS (SELECT cast(row_number() OVER (ORDER BY score DESC, cluster) AS int) AS rank, * FROM best)"""


LATEST = "update_year = (SELECT max(update_year) FROM grid)"
LAST_THREE = (
    "update_year IN (SELECT DISTINCT update_year FROM grid ORDER BY update_year DESC LIMIT 3)"
)
SHORT_LABEL = (
    "ranked.cluster || ': ' || coalesce(trim(string_split(label_auto, ',')[1]), "
    "cast(ranked.cluster AS varchar))"
)


def oracles() -> dict[str, str]:
    corpus = f"WITH {CORPUS}"
    latex = f"WITH {LATEX}"
    components = "SELECT {keys}, cast(component AS int) AS component, {value} AS value FROM {source}"
    return {
        "ndjson_scan": f"""{latex}, lines AS (SELECT to_json(fx_latex) AS line FROM fx_latex)
            SELECT line->>'$.id' AS id, line->>'$.title' AS title, line->>'$.abstract' AS abstract,
              line->>'$.update_date' AS update_date FROM lines""",
        "clean_strip": f"""{latex}
            SELECT id, {strip('title')} AS title, {strip('abstract')} AS abstract FROM fx_latex""",
        "clean_whitespace": f"""SELECT doc_id, cast(length(t) AS int) AS n_chars, md5(t) AS digest
            FROM (SELECT doc_id, {collapse('text')} AS t FROM documents)""",
        "latex_ops": f"{latex} SELECT id, {relations('abstract')} AS text FROM fx_latex",
        "latex_math_blocks": f"{latex} SELECT id, {blocks('abstract')} AS text FROM fx_latex",
        "latex_commands": f"""{latex}
            SELECT id, {scripts(styles(commands('abstract')))} AS text FROM fx_latex""",
        "latex_sci_fix": f"""{latex}
            SELECT id, {powers(scripts(relations('abstract')))} AS text FROM fx_latex""",
        "clean_corpus": CLEANED,
        "stream_clean": CLEANED,
        "weighted_text": f"""{latex}
            SELECT id, {weighted(strip('title'), strip('abstract'))} AS text FROM fx_latex""",
        "doc_year": f"{latex} SELECT id, {YEAR} AS update_year FROM fx_latex",
        "doc_filters": f"""{corpus}, {FILTERED}
            SELECT doc_id, lang, cast({N_WORDS} AS int) AS n_words FROM docs""",
        "strip_accents": """SELECT doc_id, cast(length(t) AS int) AS n_chars, md5(t) AS digest
            FROM (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)""",
        "tokens": positions(letter_tokens("text"), "token"),
        "tokens_b": positions(word_tokens("text"), "token"),
        "tokens_nostop": positions(without(letter_tokens("text"), LETTER_STOP), "token"),
        "ngrams": positions(
            f"list_concat(toks, {PAIRS})",
            "term",
            f"(SELECT doc_id, {without(letter_tokens('text'), LETTER_STOP)} AS toks "
            "FROM documents)",
        ),
        "term_counts": f"""{corpus}, {FILTERED}, {counts('docs', 'doc_id', 'counts')}
            SELECT doc_id, term, cast(tf AS int) AS tf FROM counts""",
        "vocabulary": f"""{corpus}, {FILTERED}, {counts('docs', 'doc_id', 'counts')}, {vocab(None)}
            SELECT term, df, cf, {r6('idf')} AS idf FROM vocab""",
        "vocabulary_capped": f"""{corpus}, {FILTERED}, {counts('docs', 'doc_id', 'counts')},
            {vocab(SMALL_VOCABULARY)} SELECT term, df, cf, {r6('idf')} AS idf FROM vocab""",
        "tfidf": f"{TFIDF} SELECT doc_id, term, {r6('weight')} AS weight FROM tfidf",
        "tfidf_stats": f"""{TFIDF} SELECT (SELECT count(*) FROM docs) AS n_docs,
            (SELECT count(*) FROM vocab) AS n_terms, (SELECT count(*) FROM tfidf) AS nnz""",
        "tfidf_transform": f"""{FIT}, {counts('benchmark', 'item_id', 'new_counts')},
            {weights('new_counts', 'item_id', 'new_tfidf')}
            SELECT item_id, term, {r6('weight')} AS weight FROM new_tfidf""",
        "total_variance": f"""{TFIDF} SELECT {r6('sum(q / n - (s / n) * (s / n))')} AS total_variance
            FROM (SELECT sum(weight) AS s, sum(weight * weight) AS q FROM tfidf GROUP BY term),
              (SELECT count(*) AS n FROM docs)""",
        "gram_matrix": f"""WITH {LONG} SELECT cast(a.component AS int) AS i,
              cast(b.component AS int) AS j, {r6('sum(a.value * b.value)')} AS g
            FROM long a JOIN long b USING (vec_id) GROUP BY a.component, b.component""",
        "svd_full_rank": f"""WITH {LONG} SELECT round(sum(value * value), 4) AS squares,
            1.0::DOUBLE AS explained_variance FROM long""",
        "svd_blocks": f"""WITH {LONG} SELECT round(sum(value * value), 4) AS squares,
            1.0::DOUBLE AS explained_variance FROM long""",
        "svd_whiten_gram": f"""{FIT}, sized AS (
              SELECT unnest(range(0, least(300, count(*) // 4))) AS i FROM docs)
            SELECT cast(a.i AS int) AS i, cast(b.i AS int) AS j,
              (CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END)::DOUBLE AS g FROM sized a, sized b""",
        "project_rows": f"""{TFIDF}, parts AS (
              SELECT doc_id, weight, length(term) AS len, unnest(range(0, 8)) AS component FROM tfidf),
            projected AS (SELECT docs.doc_id, d.component,
                coalesce(sum(weight * ((len * (d.component + 1)) % 7 - 3)), 0.0) AS value
              FROM docs CROSS JOIN (SELECT unnest(range(0, 8)) AS component) d
              LEFT JOIN parts ON parts.doc_id = docs.doc_id AND parts.component = d.component
              GROUP BY docs.doc_id, d.component)
            {components.format(keys='doc_id', value=r6('value'), source='projected')}""",
        "candidate_embedding": f"""{FIT}, {counts('benchmark', 'item_id', 'new_counts')},
            {weights('new_counts', 'item_id', 'new_tfidf')}, parts AS (
              SELECT item_id, weight, length(term) AS len, unnest(range(0, 8)) AS component FROM new_tfidf),
            raw AS (SELECT b.item_id, d.component,
                coalesce(sum(weight * ((len * (d.component + 1)) % 7 - 3)), 0.0) AS value
              FROM benchmark b CROSS JOIN (SELECT unnest(range(0, 8)) AS component) d
              LEFT JOIN parts ON parts.item_id = b.item_id AND parts.component = d.component
              GROUP BY b.item_id, d.component),
            projected AS (SELECT item_id AS cand_id, component, CASE WHEN norm > 0 THEN value / norm ELSE 0 END AS value
              FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS norm FROM raw))
            {components.format(keys='cand_id', value=r6('value'), source='projected')}""",
        "clean_round_trip": CLEANED,
        "csv_round_trip": f"{corpus}, {CODE_COUNTS} SELECT * FROM code_counts",
        "model_round_trip": f"{FIT} SELECT term, cast(row_number() OVER (ORDER BY term) - 1 AS int) AS term_id, df, cf, {r6('idf')} AS idf FROM vocab",
        "embedding_scan": f"""WITH {LONG}
            {components.format(keys='vec_id', value=r6('value'), source='long')}""",
        "embedding_meta_mismatch": """
            SELECT doc_id, CASE WHEN n_left > n_right THEN 'left' ELSE 'right' END AS side,
              n_left, n_right
            FROM (SELECT doc_id, cast(sum(l) AS bigint) AS n_left, cast(sum(r) AS bigint) AS n_right
              FROM (SELECT vec_id AS doc_id, 1 AS l, 0 AS r FROM embeddings
                UNION ALL SELECT doc_id, 0, 1 FROM documents) GROUP BY doc_id)
            WHERE n_left <> n_right""",
        "row_count_mismatch": """
            SELECT doc_id, CASE WHEN n_left > n_right THEN 'left' ELSE 'right' END AS side,
              n_left, n_right
            FROM (SELECT doc_id, cast(sum(l) AS bigint) AS n_left, cast(sum(r) AS bigint) AS n_right
              FROM (SELECT doc_id, 1 AS l, 0 AS r FROM documents
                UNION ALL SELECT doc_id, 0, 1 FROM documents
                UNION ALL SELECT doc_id, 0, 1 FROM labels) GROUP BY doc_id)
            WHERE n_left <> n_right""",
        "silhouette_score": f"""WITH vectors AS (SELECT vec_id, label AS cluster,
              list_transform(cast(embedding AS double[]), lambda x: CASE WHEN vec_id % 5 = 0 THEN 0 ELSE x END) AS v
              FROM embeddings),
            unit_rows AS (SELECT vec_id, cluster, CASE WHEN list_dot_product(v, v) > 0
              THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS u FROM vectors),
            pairs AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other,
                1.0 - list_dot_product(a.u, b.u) AS d
              FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
            means AS (SELECT vec_id, own, other, avg(d) AS d FROM pairs GROUP BY vec_id, own, other),
            sides AS (SELECT vec_id, own, max(CASE WHEN own = other THEN d END) AS a,
                min(CASE WHEN own <> other THEN d END) AS b FROM means GROUP BY vec_id, own)
            SELECT {r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette
            FROM sides""",
        "copies_dropped": f"""{corpus} SELECT cluster, count(*) AS n_docs,
            count(*) - count(DISTINCT text) AS n_dropped FROM fx_corpus GROUP BY cluster""",
        "normalize_rows": f"""WITH {LONG}
            {components.format(keys='vec_id', value=r6('value'), source='unit')}""",
        "hash_sample": f"""{corpus} SELECT id, cluster FROM fx_corpus
            ORDER BY md5(id || '#0') LIMIT {SMALL_SAMPLE}""",
        "assign_nearest": f"""WITH {LONG}, {CENTERS}, {NEAREST}
            SELECT vec_id, cluster, {r6('distance')} AS distance FROM near""",
        "kmeans_step": f"""WITH {LONG}, {CENTERS}, {NEAREST}, moved AS (
              SELECT cluster, component, count(*) AS n, avg(value) AS value FROM (
                SELECT cluster, unnest(range(0, len(v))) AS component, unnest(v) AS value FROM near)
              GROUP BY cluster, component)
            {components.format(keys='cluster, n', value=r6('value'), source='moved')}""",
        "kmeans_restart_step": f"WITH {LONG}, {TWO_STEPS} {model_rows('n2', 'm2')}",
        "kmeans_cheapest": f"""WITH {LONG}, {TWO_STEPS} SELECT vec_id, cast(cluster AS int) AS cluster FROM n2
            WHERE model = (SELECT model FROM n2 GROUP BY model ORDER BY sum(d), model LIMIT 1)""",
        "kmeans_minibatch_step": f"""WITH {LONG}, {CENTERS},
            m0 AS (SELECT 0 AS model, cluster, center, 0 AS seen FROM centers),
            b0 AS (SELECT * FROM vectors WHERE {BATCH} = 0), b1 AS (SELECT * FROM vectors WHERE {BATCH} = 1),
            {nearest_center('b0', 'm0', 'n0')}, {batch_center('n0', 'm0', 'm1')},
            {nearest_center('b1', 'm1', 'n1')}, {batch_center('n1', 'm1', 'm2')},
            {nearest_center('vectors', 'm2', 'n2')} {model_rows('n2', 'm2')}""",
        "kmeans_choose_k": f"""WITH {LONG}, u AS (SELECT vec_id, u AS v FROM unit_rows),
            {dealt_centers('u')}, {nearest_center('u', 'm0', 'n0')}, {mean_center('n0', 'm0', 'm1')},
            {nearest_center('u', 'm1', 'n1')},
            pairs AS (SELECT a.model, a.vec_id, a.cluster AS own, b.cluster AS other,
                avg(1.0 - list_dot_product(a.v, b.v)) AS d
              FROM n1 a JOIN n1 b ON a.model = b.model AND a.vec_id <> b.vec_id GROUP BY ALL),
            sides AS (SELECT model, vec_id, max(CASE WHEN own = other THEN d END) AS a,
                min(CASE WHEN own <> other THEN d END) AS b FROM pairs GROUP BY model, vec_id),
            scored AS (SELECT model, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s
              FROM sides GROUP BY model)
            SELECT cast(2 * model + 3 AS int) AS k, {r6('s')} AS silhouette,
              model = (SELECT model FROM scored ORDER BY s DESC, model LIMIT 1) AS chosen FROM scored""",
        "silhouette_by_label": f"""WITH {LONG}, pairs AS (
              SELECT a.vec_id, a.cluster AS own, b.cluster AS other,
                1.0 - list_dot_product(a.u, b.u) AS d
              FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
            means AS (SELECT vec_id, own, other, avg(d) AS d FROM pairs GROUP BY vec_id, own, other),
            sides AS (SELECT vec_id, own, max(CASE WHEN own = other THEN d END) AS a,
                min(CASE WHEN own <> other THEN d END) AS b FROM means GROUP BY vec_id, own)
            SELECT own AS cluster, count(*) AS n,
              {r6('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette
            FROM sides GROUP BY own""",
        "cluster_sizes": f"""{corpus} SELECT cluster, count(*) AS n FROM fx_corpus GROUP BY cluster
            ORDER BY n DESC, cluster LIMIT 10""",
        "cluster_top_terms": f"{TOP_TERMS} SELECT cluster, top_terms FROM top_terms",
        "term_legend": f"""{TOP_TERMS} SELECT cluster, cluster || ': ' ||
            array_to_string(string_split(top_terms, ', ')[1:3], ', ') AS label FROM top_terms""",
        "cluster_centroids": f"""WITH {LONG}, {CENTROIDS}
            {components.format(keys='cluster, n', value=r6('value'), source='centroids')}""",
        "centroid_similarity": f"""WITH {LONG}, {CENTROIDS}, {SIMILARITY}
            SELECT cluster, cand_id, {r6('similarity')} AS similarity FROM likeness""",
        "zero_shot_labels": f"""WITH {LONG}, {CENTROIDS}, {SIMILARITY}, placed AS (
              SELECT cluster, 'topic ' || cand_id AS name, row_number() OVER (
                PARTITION BY cluster ORDER BY {r9('similarity')} DESC, cand_id) AS place
              FROM likeness)
            SELECT cluster, max(CASE WHEN place = 1 THEN name END) AS label_auto,
              string_agg(name, ', ' ORDER BY place) AS label_alt
            FROM placed WHERE place <= 3 GROUP BY cluster""",
        "phrase_input": f"""{corpus}, {LONG_TEXTS} SELECT id, cluster,
            cast(length(text) AS int) AS n_chars,
            cast(length(substr(text, 1, 50000)) AS int) AS n_chars_cut FROM long_texts""",
        "reservoir_per_cluster": f"""{corpus}, {LONG_TEXTS} SELECT id, cluster FROM long_texts
            QUALIFY row_number() OVER (PARTITION BY cluster 
              ORDER BY md5(id || '#' || sha256(text) || '#0')) <= {SMALL_RESERVOIR}""",
        "dedup_per_cluster": f"""{corpus} SELECT id, cluster FROM fx_corpus
            QUALIFY row_number() OVER (PARTITION BY cluster, text ORDER BY id) = 1""",
        "cluster_phrases": phrases(CORPUS),
        "cluster_phrases_shared_ids": phrases(SHARED_IDS),
        "extract_codes": f"""{corpus} SELECT id, array_to_string({CODES}, '|') AS codes,
            cast(len({CODES}) AS int) AS n_codes FROM fx_corpus""",
        "category_counts": f"{corpus}, {CODE_COUNTS} SELECT * FROM code_counts",
        "category_top_codes": f"""{corpus}, {CODE_COUNTS}, {TOP_CODES}
            SELECT cluster, cast(place AS int) AS place, codes, n, share FROM top_codes""",
        "category_labels": f"{corpus}, {LABELLED} SELECT * FROM code_labels",
        "label_join": f"""{corpus}, {LABELLED} SELECT id, cluster, update_year,
            array_to_string({CODES}, '|') AS codes, label_auto, label_alt
            FROM fx_corpus LEFT JOIN code_labels USING (cluster)""",
        "yearly_share": f"{corpus}, {SHARE} SELECT * FROM share",
        "yearly_share_wide": f"""{corpus}, {SHARE} SELECT update_year, {', '.join(
            f'coalesce(max(CASE WHEN cluster = {c} THEN share END), 0.0) AS "{c}"'
            for c in range(12))} FROM share GROUP BY update_year""",
        "yearly_share_dense": f"{corpus}, {SHARE} SELECT * FROM grid",
        "wide_to_long_share": f"""{corpus}, {SHARE} SELECT y.update_year, c.cluster,
              coalesce(s.share, 0.0) AS share
            FROM (SELECT DISTINCT update_year FROM share) y
            CROSS JOIN (SELECT cast(unnest(range(0, 12)) AS int) AS cluster) c
            LEFT JOIN share s ON s.update_year = y.update_year AND s.cluster = c.cluster""",
        "top_clusters_total": f"{corpus}, {SHARE}, {ranking('sum(share)', 8)} SELECT * FROM ranked",
        "top_topics_overall": f"{corpus}, {SHARE}, {ranking('avg(share)', 10)} SELECT * FROM ranked",
        "top_topics_last": f"""{corpus}, {SHARE}, {ranking('sum(share)', 10, LATEST)}
            SELECT * FROM ranked""",
        "top_topics_last3": f"""{corpus}, {LABELLED}, {SHARE},
            {ranking('sum(share)', 10, LAST_THREE)}
            SELECT rank, ranked.cluster, {SHORT_LABEL} AS label, score
            FROM ranked LEFT JOIN code_labels ON ranked.cluster = code_labels.cluster""",
        "top_topics_series": f"""{corpus}, {LABELLED}, {SHARE},
            {ranking('sum(share)', 10, LAST_THREE)}
            SELECT rank, ranked.cluster, {SHORT_LABEL} AS label, update_year, share
            FROM ranked LEFT JOIN code_labels ON ranked.cluster = code_labels.cluster
            JOIN grid ON grid.cluster = ranked.cluster""",
        "map_legend": f"""{corpus}, {LABELLED}, sampled AS (
              SELECT * FROM fx_corpus ORDER BY md5(id || '#0') LIMIT 200000),
            sizes AS (SELECT cluster, count(*) AS n FROM sampled GROUP BY cluster
              ORDER BY n DESC, cluster LIMIT 12)
            SELECT cluster, n, cluster || ': ' || coalesce(label_auto, cast(cluster AS varchar))
              AS label FROM sizes LEFT JOIN code_labels USING (cluster)""",
        "knn_cosine": f"""WITH {LONG}, pairs AS (
              SELECT a.vec_id, b.vec_id AS neighbor,
                greatest({r9('1.0 - list_dot_product(a.u, b.u)')}, 0.0) AS d
              FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
            placed AS (SELECT *, row_number() OVER (
                PARTITION BY vec_id ORDER BY d, neighbor) AS place FROM pairs)
            SELECT vec_id, neighbor, {r6('d')} AS distance, cast(place AS int) AS place
            FROM placed WHERE place <= 30""",
        "knn_fuzzy_graph": f"""WITH RECURSIVE {LONG}, pairs AS (
              SELECT a.vec_id AS id, b.vec_id AS other, greatest({r9('1.0 - list_dot_product(a.u, b.u)')}, 0.0) AS d
              FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
            near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 30),
            listed AS (SELECT id, list(other ORDER BY d, other) AS others, list(d ORDER BY d, other) AS ds,
                coalesce(min(d) FILTER (d > 0), 0) AS rho, avg(d) AS mean FROM near GROUP BY id),
            beyond AS (SELECT *, list_transform(ds, lambda d: greatest(d - rho, 0)) AS b FROM listed),
            search AS (
              SELECT id, b, 0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1.0::DOUBLE AS sigma, 0 AS step FROM beyond
              UNION ALL SELECT id, b, new_low, new_high, greatest(least(CASE WHEN isinf(new_high) THEN sigma * 2
                  ELSE (new_low + new_high) / 2 END, 1e12::DOUBLE), 1e-12::DOUBLE), step + 1
              FROM (SELECT *, CASE WHEN above THEN sigma ELSE high END AS new_high,
                  CASE WHEN above THEN low ELSE sigma END AS new_low
                FROM (SELECT *, list_sum(list_transform(b, lambda x: exp(-x / sigma))) > log2(30) AS above
                  FROM search WHERE step < 64))),
            found AS (SELECT id, greatest(sigma, 1e-3::DOUBLE * greatest(mean, 1e-12::DOUBLE)) AS sigma
              FROM search JOIN listed USING (id) WHERE step = 64),
            edges AS (SELECT id, unnest(others) AS other, exp(-unnest(b) / sigma) AS w FROM beyond JOIN found USING (id)),
            both_ways AS (SELECT id AS src, other AS dst, w FROM edges WHERE w > 0
              UNION ALL SELECT other, id, w FROM edges WHERE w > 0)
            SELECT src, dst, {r6('sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END')} AS weight
            FROM both_ways GROUP BY src, dst""",
        "topic_map_table": f"""SELECT vec_id, label AS cluster,
            CASE WHEN label % 2 = 0 THEN concat('topic ', label) ELSE cast(label AS varchar) END AS label,
            cast((dense_rank() OVER (ORDER BY label) - 1) % 20 AS int) AS color, TRUE AS placed FROM embeddings""",
        "ndjson_quarantine": """SELECT CASE WHEN p_partkey % 19 <> 0 THEN cast(p_partkey AS varchar) END AS id,
            CASE WHEN p_partkey % 19 = 0 THEN concat('{"id":"', p_partkey, '"') END AS line FROM part""",
        "run_report": f"""{TFIDF}, numbers AS (SELECT (SELECT count(*) FROM docs) AS n_docs,
              (SELECT count(*) FROM tfidf) AS nnz, (SELECT count(*) FROM docs) - (SELECT count(DISTINCT doc_id) FROM tfidf)
                AS n_empty, (SELECT count(*) FROM docs WHERE doc_id IS NULL) AS null_ids)
            SELECT metric, value FROM numbers UNPIVOT (value FOR metric IN (n_docs, nnz, n_empty, null_ids))""",
        "attach_cluster": f"{corpus} SELECT id, update_year, cluster FROM fx_corpus",
        "assign_stream": f"""{FIT}, {counts('benchmark', 'item_id', 'new_counts')},
            {weights('new_counts', 'item_id', 'new_tfidf')}, parts AS (
              SELECT item_id, weight, length(term) AS len, unnest(range(0, 8)) AS component FROM new_tfidf),
            raw AS (SELECT b.item_id, d.component,
                coalesce(sum(weight * ((len * (d.component + 1)) % 7 - 3)), 0.0) AS value
              FROM benchmark b CROSS JOIN (SELECT unnest(range(0, 8)) AS component) d
              LEFT JOIN parts ON parts.item_id = b.item_id AND parts.component = d.component
              GROUP BY b.item_id, d.component),
            unit_raw AS (SELECT item_id, component, CASE WHEN norm > 0 THEN value / norm ELSE 0 END AS value, norm > 0 AS known
              FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY item_id)) AS norm FROM raw))
            SELECT item_id, cast(component AS int) AS cluster,
              {r6('CASE WHEN known THEN 2 - 2 * value ELSE 1 END')} AS distance FROM unit_raw
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY value DESC, component) = 1""",
        "layout_stretch": f"""WITH {PLACES} SELECT {r6('edge / pair')} AS stretch
            FROM (SELECT sum(weight * (pow(s.x - d.x, 2) + pow(s.y - d.y, 2))) / sum(weight) AS edge
              FROM edges JOIN places s ON s.id = src JOIN places d ON d.id = dst),
              (SELECT 2 * (var_pop(x) + var_pop(y)) AS pair FROM places)""",
        "layout_step": f"""WITH {PLACES}, box AS (SELECT min(x) AS lx, min(y) AS ly,
              greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9::DOUBLE) AS side, count(*) AS total FROM places),
            pulls AS (SELECT src AS id, sum(weight) AS degree, sum(pull * gx) AS ax, sum(pull * gy) AS ay FROM (
              SELECT src, weight, gx, gy, CASE WHEN q > 0 THEN weight * (-2 * 1.75::DOUBLE * 0.84::DOUBLE)
                  * pow(q, -0.16::DOUBLE) / (1 + 1.75::DOUBLE * pow(q, 0.84::DOUBLE)) ELSE 0 END AS pull
              FROM (SELECT src, weight, s.x - d.x AS gx, s.y - d.y AS gy, pow(s.x - d.x, 2) + pow(s.y - d.y, 2) AS q
                FROM edges JOIN places s ON s.id = src JOIN places d ON d.id = dst)) GROUP BY src),
            celled AS (SELECT p.*, level, floor((x - lx) / side * pow(2, level))::INT AS cx,
                floor((y - ly) / side * pow(2, level))::INT AS cy
              FROM places p, box, (SELECT unnest([1, 2, 3]) AS level)),
            sums AS (SELECT level, cx, cy, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM celled GROUP BY ALL),
            met AS (SELECT r.id, r.x, r.y,
                s.n - m AS n, s.sx - m * r.x AS sx, s.sy - m * r.y AS sy
              FROM celled r JOIN sums s ON s.level = r.level AND abs(s.cx // 2 - r.cx // 2) <= 1
                AND abs(s.cy // 2 - r.cy // 2) <= 1
                AND (r.level = 3 OR abs(s.cx - r.cx) > 1 OR abs(s.cy - r.cy) > 1),
              LATERAL (SELECT CASE WHEN s.cx = r.cx AND s.cy = r.cy THEN 1 ELSE 0 END AS m)),
            pushes AS (SELECT id, sum(f * gx) AS rx, sum(f * gy) AS ry FROM (
              SELECT id, gx, gy, n * 2 * 0.84::DOUBLE / ((0.001::DOUBLE + gx * gx + gy * gy)
                  * (1 + 1.75::DOUBLE * pow(gx * gx + gy * gy, 0.84::DOUBLE))) AS f
              FROM (SELECT id, n, x - sx / n AS gx, y - sy / n AS gy FROM met WHERE n > 0)) GROUP BY id)
            SELECT p.id AS vec_id,
              {r6('x + 0.5 * greatest(least(coalesce(ax + degree * (5.0::DOUBLE / total) * rx, 0), 4), -4)')} AS x,
              {r6('y + 0.5 * greatest(least(coalesce(ay + degree * (5.0::DOUBLE / total) * ry, 0), 4), -4)')} AS y
            FROM places p, box LEFT JOIN pulls ON pulls.id = p.id LEFT JOIN pushes ON pushes.id = p.id""",
        "knn_cosine_cells": f"""WITH {LONG}, {CENTERS}, {CELLS}, pairs AS (
              SELECT a.vec_id, b.vec_id AS neighbor,
                greatest({r9('1.0 - list_dot_product(a.u, b.u)')}, 0.0) AS d
              FROM ranked a JOIN ranked b ON a.cell = b.cell AND a.vec_id <> b.vec_id
              WHERE a.rank <= 4 AND b.rank = 1),
            placed AS (SELECT *, row_number() OVER (
                PARTITION BY vec_id ORDER BY d, neighbor) AS place FROM pairs)
            SELECT vec_id, neighbor, {r6('d')} AS distance, cast(place AS int) AS place
            FROM placed WHERE place <= 30""",
        "knn_cell_recall": f"""WITH {LONG}, {CENTERS}, {CELLS}, pairs AS (
              SELECT a.vec_id, b.vec_id AS neighbor, {r9('1.0 - list_dot_product(a.u, b.u)')} AS d
              FROM unit_rows a JOIN unit_rows b ON a.vec_id <> b.vec_id),
            near AS (SELECT * FROM pairs
              QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor) <= 30),
            met AS (SELECT a.rank FROM near n JOIN ranked b ON b.vec_id = n.neighbor AND b.rank = 1
              JOIN ranked a ON a.vec_id = n.vec_id AND a.cell = b.cell)
            SELECT cast(p AS int) AS probes, {r6('count(rank) FILTER (rank <= p) / count(rank)')} AS recall
            FROM met, (SELECT DISTINCT rank AS p FROM ranked) GROUP BY p""",
    }
