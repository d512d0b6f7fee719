"""Queries of the training-data operators, each over its whole table, and their SQL.

Those without SQL need a trained model, alignment or sequential packing. The tests
compare them with brute force, round trips and held-out accuracy instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import ann, decontaminate, html_extract, language_id, line_dedup, near_dedup, packing, pii, quality, url_filter
from lexloom.llm._common import read


def op1_pii(spark, sf_dir):
    return pii.find_pii(spark, read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(spark, read(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return url_filter.filter_urls(spark, read(spark, sf_dir, "pages"))


def op4_approximate_nearest_neighbours(spark, sf_dir):
    """Every row whose id is divisible by 100, against all rows."""
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(spark, rows, rows.where(F.col("vec_id") % 100 == 0))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(spark, read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(spark, read(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.pack(spark, read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark, sf_dir):
    return html_extract.extract(spark, read(spark, sf_dir, "pages"))


def op10_quality_classifier(spark, sf_dir):
    return quality.classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ALL = (op1_pii, op2_minhash_near_dedup, op3_url_filter, op4_approximate_nearest_neighbours, op5_line_dedup, op6_language_id, op7_packing, op8_benchmark_decontamination, op9_html_extraction, op10_quality_classifier)
QUERIES = {f.__name__: f for f in _ALL}

#: Words of a text: what stands between separators. The test tables have no text in a script without spaces.
_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '([\x00-\x2F\x3A-\x60\x7B-\x7F\x{85}]|\p{P}|\p{Z})+'), lambda x: x <> '')"
ORACLE_SQL: dict[str, str] = {
    # every pair of documents that share a shingle, without sketches; components by reachability
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c.c / (a.n + b.n - c.c) >= {near_dedup.THRESHOLD}),
        r AS (SELECT DISTINCT x AS id, x AS m FROM p UNION SELECT p.y, r.m FROM r JOIN p ON p.x = r.id),
        g AS (SELECT id AS doc_id, min(m) AS group_id FROM r GROUP BY id)
        SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS kept FROM g""",
    # every item against every document by exact containment, without sketches
    "op8_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4])) AS s FROM d),
        s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4])) AS s FROM i),
        n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
        SELECT doc_id, item_id, count(*) / any_value(n.n) AS containment FROM s JOIN ds USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING count(*) / any_value(n.n) >= {decontaminate.THRESHOLD}
        UNION ALL
        SELECT doc_id, item_id, 1.0 FROM d, i WHERE len(i.w) BETWEEN 1 AND 4
        AND len(list_filter(range(1, len(d.w) - len(i.w) + 2), lambda k: d.w[k:k + len(i.w) - 1] = i.w)) > 0""",
}
