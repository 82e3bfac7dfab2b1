"""The queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm import byte_bpe, decontaminate, exact_dedup, hard_negatives, html_text, mixing, ngram_join, quality, spelling, substring_dedup, token_counts, toxicity, url_filter
from foldstone.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
)
def op1_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op3_source_mix",
    r"""WITH RECURSIVE d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM d GROUP BY source),
    w AS (SELECT source, source_size, 2 * source_size AS cap, ([5, 2, 1])[((i - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, weight, source NULLS LAST) AS j FROM w),
    l AS (SELECT a.j, (1.5::DOUBLE * (SELECT sum(source_size) FROM r)::DOUBLE - coalesce((SELECT sum(cap) FROM r WHERE r.j < a.j), 0)::DOUBLE)
        / (SELECT sum(weight) FROM r WHERE r.j >= a.j)::DOUBLE AS level, a.weight, a.cap FROM r a),
    f AS (SELECT arg_min(level, j) AS level FROM l WHERE level * weight <= cap),
    t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM f) IS NULL OR (SELECT level FROM f) * weight > cap THEN cap::DOUBLE ELSE (SELECT level FROM f) * weight END AS target FROM r),
    p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, source, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken FROM p""",
)
def op3_source_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query("op4_quality")
def op4_quality(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op5_url_filter",
    r"""WITH rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    p AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(host, path, rule, verdict) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
    b AS (SELECT page_id, p.url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules r
      ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1, 2)
    SELECT p.page_id, p.url, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.page_id = b.page_id AND p.url IS NOT DISTINCT FROM b.url""",
)
def op5_url_filter(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


@query(
    "op6_ngram_join",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[k:k + 3], ' ') FOR k IN range(1, len(w) - 2)])
      WHEN len(w) > 0 THEN ['short: ' || array_to_string(w, ' ')] ELSE [] END AS g FROM d),
    e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    o AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS m, b.n AS n, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
    l AS (SELECT u, v FROM o WHERE 100 * c >= 85 * (m + n - c)),
    r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
    c AS (SELECT u, min(v) AS component_id FROM r GROUP BY 1), k AS (SELECT u, count(*) AS n_links FROM l GROUP BY 1)
    SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s JOIN c ON c.u = doc_id LEFT JOIN k ON k.u = doc_id""",
)
def op6_ngram_join(spark, folder):
    return ngram_join.linked_sets(table(spark, folder, "documents"))


@query(
    "op7_substring_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    a AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
    win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM a),
    f AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, p + k AS p FROM win JOIN f USING (g), range(0, 13) t(k) WHERE first_id < doc_id),
    word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
)
def op7_substring_dedup(spark, folder):
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark, folder):
    return token_counts.section_tokens(table(spark, folder, "documents"))


@query(
    "op9_decontamination",
    r"""WITH i AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
    q AS (SELECT item_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) END AS s FROM i WHERE len(w) > 0),
    qs AS (SELECT item_id, len(s) AS item_size, unnest(s) AS g FROM q),
    sizes AS (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0),
    d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
    ds AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)])) AS g FROM d JOIN sizes ON len(w) >= n)
    SELECT doc_id, item_id, item_size, count(*) AS n_shared, round(count(*) / item_size, 6) AS containment FROM ds JOIN qs USING (g)
    GROUP BY doc_id, item_id, item_size HAVING count(*) / item_size >= 0.8""",
)
def op9_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_html_text")
def op10_html_text(spark, folder):
    return html_text.main_text(table(spark, folder, "pages"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark, folder):
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents")))
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents"), every=199)


@query(
    "op13_hard_negatives",
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_inner_product(a.q, o.q)::BIGINT AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3""",
)
def op13_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.select("vec_id", shifted.alias("label"), "embedding"), lambda vec_id: vec_id % 50 == 0)
