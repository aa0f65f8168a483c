"""The registered queries of this subpackage and the SQL some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import brown_lm, centroid_clustering, collocations, decontamination, html_extract, jaccard_join, language_id, line_dedup, mixing, token_counts, topk_search, toxicity, url_filters
from tallyframe.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filters.judged(table(spark, sf_dir, "pages")).drop("node")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every whole document."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))[0]


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole document under the class bigram model."""
    return brown_lm.scored_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole document."""
    return language_id.identified(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every whole document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without later repeated runs of lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to each query vector."""
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every whole vector after five rounds."""
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))[0]


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations."""
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("left_most", "right_most")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_ngram_jaccard_join, op3_lm_scoring, op4_language_id, op5_token_counts, op6_html_extraction, op7_benchmark_decontamination, op8_line_dedup, op9_source_mixing, op10_exact_top_k,
                                 op11_centroid_clustering, op12_phrase_mining, op13_toxicity)}

_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_url_filters": r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, coalesce(url, '') AS url,
         CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after
  FROM pages
), u AS (
  SELECT page_id, html, contains(url, '://') AS absolute,
         translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(after, '^[^/?#]*([^#]*)', 1) AS rest
  FROM p
), tags AS (
  SELECT host, host || rest AS node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM u WHERE absolute
), found AS (
  SELECT host, node, replace(CASE
    WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  END, '&amp;', '&') AS target FROM tags
), targets AS (
  SELECT node, CASE WHEN contains(target, '://') THEN substr(target, position('://' IN target) + 3)
                    WHEN starts_with(target, '//') THEN substr(target, 3)
                    WHEN starts_with(target, '/') THEN host || target END AS t
  FROM found WHERE target <> ''
), edges AS (
  SELECT node AS a, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS b
  FROM targets WHERE t IS NOT NULL
), twoway AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM twoway UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON r.b = e.a),
rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), named AS (SELECT host || rest AS node, host, path FROM u
  UNION SELECT b, regexp_extract(b, '^[^/?#]*'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach
), best AS (
  SELECT node, n.host, n.path, r.host || r.path AS rule, verdict FROM named n
  LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY node, n.host, n.path ORDER BY length(r.host) + length(r.path) DESC NULLS LAST) = 1
)
SELECT u.page_id, u.host, u.path, x.rule,
       coalesce(x.verdict, CASE WHEN EXISTS (
         SELECT 1 FROM reach JOIN best y ON y.node = reach.b WHERE reach.a = u.host || u.rest AND y.verdict = 'block') THEN 'block' END, 'allow') AS verdict
FROM u JOIN best x ON x.node = u.host || u.rest AND x.host = u.host AND x.path = u.path
""",
    "op7_benchmark_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '{_ITEM_WORDS}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_FOLD.format("text")}, '{_ITEM_WORDS}') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, p, p + least(13, len(w)) - 1) AS k
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT r, p, n, list_slice(w, p, p + n - 1) AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), m AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
    "op8_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(text) AS tkey FROM documents),
split AS (SELECT DISTINCT doc_id, tkey, string_split(text, chr(10)) AS l FROM d WHERE text IS NOT NULL),
raw AS (SELECT doc_id, tkey, unnest(l) AS line, unnest(range(len(l))) AS n FROM split),
told AS (SELECT doc_id, tkey, n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw),
l AS (
  SELECT doc_id, tkey, n, md5(array_to_string(w, ' ')) AS h, len(w) AS w,
         row_number() OVER (PARTITION BY doc_id, tkey ORDER BY n) AS p,
         sum(len(w)) OVER (PARTITION BY doc_id, tkey ORDER BY n) AS upto
  FROM told WHERE len(w) > 0
), win AS (
  SELECT a.doc_id, a.tkey, a.p AS s, b.p AS e
  FROM l a JOIN l b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.tkey = b.tkey AND b.p >= a.p AND b.upto - (a.upto - a.w) >= 20
    AND (b.upto - b.w - (a.upto - a.w) < 20 OR b.upto - a.upto < 20)
), run AS (
  SELECT v.doc_id, v.tkey, s, e, string_agg(h, ' ' ORDER BY p) AS content
  FROM win v JOIN l ON v.doc_id IS NOT DISTINCT FROM l.doc_id AND v.tkey = l.tkey AND p BETWEEN s AND e GROUP BY ALL
), later AS (
  SELECT doc_id, tkey, s, e FROM run
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, tkey, s) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.tkey, n
  FROM later v JOIN l ON v.doc_id IS NOT DISTINCT FROM l.doc_id AND v.tkey = l.tkey AND p BETWEEN s AND e
),
left_over AS (
  SELECT raw.doc_id, raw.tkey, coalesce(string_agg(line, chr(10) ORDER BY raw.n) FILTER (gone.n IS NULL), '') AS text,
         count(*) AS n_lines, count(gone.n) AS n_removed
  FROM raw LEFT JOIN gone ON raw.doc_id IS NOT DISTINCT FROM gone.doc_id AND raw.tkey = gone.tkey AND raw.n = gone.n GROUP BY ALL
)
SELECT d.doc_id, o.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN left_over o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.tkey = o.tkey
""",
    "op9_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS total, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS n FROM s
), c AS (
  SELECT *, CAST(coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ahead FROM o
), f AS (SELECT *, bool_and((total - before) * w > 3 * source_size * ahead) OVER (ORDER BY n) AS capped FROM c
), e AS (
  SELECT max(total) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS rest, sum(w) FILTER (NOT capped) AS share FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(CAST(rest AS BIGINT) * w AS DOUBLE) / CAST(share AS DOUBLE) END AS target
  FROM f, e
), q AS (
  SELECT d.*, source_size, target, CAST(least(floor(target + 0.5), 3 * source_size) AS BIGINT) AS flow,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE flow // source_size * size + greatest(0, least(size, flow % source_size - before)) END AS taken
FROM q
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}


def _clustering_sql(centroids: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, by a cross join with the centroids."""
    parts = ["""k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM k
      ORDER BY sha256('2:' || vec_id), v LIMIT {centroids})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, c, dist FROM (
      SELECT k.rid, c{r}.c, list_sum(list_transform(list_zip(k.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
      FROM k CROSS JOIN c{r}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, COALESCE(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
      SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM (
        SELECT c, p, sum(x) AS s, count(*) AS n FROM (
          SELECT a{r}.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS p FROM a{r} JOIN k USING (rid)) GROUP BY c, p)
      GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
      CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(f.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN k USING (rid) JOIN c{rounds} f ON f.c = a.c"""


ORACLE_SQL["op11_centroid_clustering"] = _clustering_sql()

ORACLE_SQL["op12_phrase_mining"] = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM pieces, generate_series(1, 5) g(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, j,
    (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM c CROSS JOIN generate_series(1, 4) g(j) JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 :], ' ') WHERE j < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[2 :], ' ') AS phrase, a FROM c WHERE k >= 3
  UNION ALL SELECT lang, array_to_string(w[1 : k - 1], ' '), a FROM c WHERE k >= 3),
held AS (SELECT lang, phrase, max(a) AS longest FROM inner_ GROUP BY lang, phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase,
    a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE longest IS NULL OR longest < a)
WHERE rank <= 2000"""
