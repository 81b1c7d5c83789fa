"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, html_text, near_duplicates, neighbours, packing, pivots, quality, ranked, substrings, suffix_model, urls, warc
from .common import table


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def urls_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.listed_only(table(spark, sf_dir, "pages"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_model.score_corpus(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest_exact(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_packing": op3_packing, "op2_neighbours": op2_neighbours, "op8_html_text": op8_html_text, "op4_suffix_model": op4_suffix_model, "op5_near_duplicates": op5_near_duplicates, "op6_substrings": op6_substrings, "op1_urls": op1_urls, "op9_decontaminate": op9_decontaminate, "op7_quality": op7_quality, "op10_warc": op10_warc, "op11_centroids": op11_centroids, "op12_ranked_search": op12_ranked_search, "op13_exact_search": op13_exact_search, "urls_listed": urls_listed}

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')"
_SOUND = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _cluster_sql(centroids: int = 40, rounds: int = 5) -> str:
    """Whole distances in each round, without increments."""
    near = """(SELECT * FROM (SELECT v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {c} c)
               QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
    steps = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS k, x FROM v ORDER BY sha256('2:' || vec_id::VARCHAR) LIMIT {centroids})"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED {near.format(c=f"c{r}")},
        m{r} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS m
               FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i) GROUP BY k),
        c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return f"""WITH {", ".join(steps)}, z AS {near.format(c=f"c{rounds}")}
        SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c USING (k)"""


ORACLES: dict[str, str] = {
    "op11_centroids": _cluster_sql(),
    "op12_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
        p AS (SELECT doc_id, {low} AS w, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // len AS m FROM n, g),
        f AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g GROUP BY w, docs),
        q AS (SELECT item_id, {low} AS w, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (w) JOIN p USING (w) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""".replace("{low}", f"translate(w, '{_AZ}', '{_AZ.lower()}')"),
    "op13_exact_search": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE {_SOUND})
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id)::INTEGER AS rank, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20""",
    "urls_listed": rf"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_AZ}', '{_AZ.lower()}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(listed, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        f AS (SELECT page_id, host, path, listed, h || p AS rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
        b AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(listed, length(rule)) AS listed FROM f GROUP BY ALL)
        SELECT u.page_id, u.host, u.path, b.rule, b.listed FROM u LEFT JOIN b ON u.page_id = b.page_id""",
    "op5_near_duplicates": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
        m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id""",
    "op9_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
        t AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
        g AS (SELECT doc_id, item_id, i, n FROM t JOIN v USING (n, k)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM g) GROUP BY doc_id),
        j AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM g) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(j.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op6_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
        r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
        g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN r USING (k)) GROUP BY doc_id),
        k AS (SELECT d.doc_id, d.w, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
        x AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
              ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM g) USING (doc_id, p) GROUP BY doc_id)
        SELECT k.doc_id, len(k.w)::BIGINT AS n_words, len(k.gone)::BIGINT AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
        FROM k LEFT JOIN x USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
        SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN f.first IS DISTINCT FROM p.page_id AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.html = f.html""",
}
