"""DuckDB SQL for the registered queries that SQL can express.

Each states the result directly, by counting and comparing everything, and not the way
the operator finds it. Languages, contextual patterns, packing, ring walks, SimHash
search, derived records, the isolation forest and the toxicity model have no SQL here;
tests compare them with brute force.
"""

from __future__ import annotations

from spendframe.llm.licenses import PERCENT, PHRASES, SPREAD, TEMPLATES, words_in_order
from spendframe.llm.mixing import SEED

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM totals
), shared AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - 3 * coalesce(CAST(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
     / CAST(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS unit
  FROM weighted
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(unit) OVER () * weight) AS target FROM shared
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
         CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS chance
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""

_NGRAM_JOIN = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS items
  FROM cut
), sized AS (SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles FROM sets
), flat AS (SELECT doc_id, unnest(items) AS item FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.item = b.item AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n_shingles + q.n_shingles - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT s.doc_id, s.n_shingles, min(r.y) AS component_id FROM sized s JOIN reach r ON r.x = s.doc_id GROUP BY 1, 2
"""


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


def _license_scan() -> str:
    places = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest([i - 1 for i in range(1, len(w) - {len(words) - 2}) if "
        + " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words)) + "]) AS place FROM cut"
        for label, words in ((label, phrase.split()) for label, phrase in PHRASES.items()))
    templates = ", ".join(
        f"({number}, '{label}', {SPREAD * len(words)}, {_words(sorted(set(words)))})"
        for number, (label, words) in enumerate((label, words_in_order(text)) for label, text in TEMPLATES))
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), places AS ({places}
), base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS labels
  FROM places GROUP BY r
), templates(t, label, run, words) AS (VALUES {templates}
), wanted AS (SELECT t, label, run, len(words) AS n, unnest(words) AS word FROM templates
), hits AS (
  SELECT * FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM cut) JOIN wanted USING (word)
), whole AS (SELECT r, t FROM hits GROUP BY r, t, n HAVING 100 * count(DISTINCT word) >= {PERCENT} * n
), blocks AS (
  SELECT a.r, a.t, a.label, a.n, a.place, count(DISTINCT b.word) AS c
  FROM whole JOIN hits a USING (r, t) JOIN hits b ON a.r = b.r AND a.t = b.t AND b.place >= a.place AND b.place < a.place + a.run
  GROUP BY a.r, a.t, a.label, a.n, a.place
), met AS (
  SELECT r, list_distinct(list(label)) AS labels, max(c / n) AS containment FROM blocks WHERE 100 * c >= {PERCENT} * n GROUP BY r
)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(b.labels, CAST([] AS VARCHAR[]))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, CAST([] AS VARCHAR[])), coalesce(m.labels, CAST([] AS VARCHAR[]))))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(m.containment, 0.0) END AS score
FROM cut c LEFT JOIN base b ON c.r = b.r LEFT JOIN met m ON c.r = m.r
"""


_RANKED_SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), sized AS (SELECT r, doc_id, len(t) AS n FROM docs WHERE len(t) > 0
), total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term
), held AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY i, item_id, term
), weighted AS (
  SELECT i, item_id, term, times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN held USING (term), total
), scored AS (
  SELECT i, item_id, s.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN sized s ON s.r = tf.r, total GROUP BY i, item_id, s.r, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 20
"""

_HARD_NEGATIVES = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), used AS (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM given
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) AS place FROM scored WHERE same)
  WHERE place <= 5
), near AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 5
"""


ORACLES: dict[str, str] = {
    "op3_source_mixing": _MIXING,
    "op4_ngram_join": _NGRAM_JOIN,
    "op6_license_scan": _license_scan(),
    "op11_ranked_search": _RANKED_SEARCH,
    "op13_hard_negatives": _HARD_NEGATIVES,
}
