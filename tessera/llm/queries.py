"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import license_scan, mixing, near_dedup, nearest, packing, quality_rules, secret_scan, site_quality, surrogates, warc
from tessera.llm.common import table


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address: their source is the host and their language the path."""
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced_texts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_site_quality, op2_secret_scan, op3_packing, op4_nearest, op5_warc, op6_mixing, op7_near_dedup, op8_surrogates, op9_license_scan, op10_quality_rules)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP5 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS o FROM p WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o IS NULL OR page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> o THEN o END AS refers_to, url
FROM p LEFT JOIN m USING (payload_digest, payload_bytes)
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, CAST(2 * ss AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place,
    (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lvl
  FROM w WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (SELECT source, ss, least(most, coalesce(weight * (SELECT arg_min(lvl, place) FROM l WHERE most >= weight * lvl), most)) AS target FROM l),
e AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, greatest(CAST(floor(target) AS BIGINT) - epochs * ss, 0) AS rest FROM e),
c AS (SELECT source, key, id, size, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT *, sum(size * n) OVER (PARTITION BY source ORDER BY key, id, size) AS done FROM c)
SELECT d.doc_id, d.size, r.ss AS source_size, r.target, d.source,
  CAST(epochs * d.size + CASE WHEN rest >= done THEN d.size WHEN rest < done - d.size * n THEN 0 ELSE (rest - (done - d.size * n)) // n END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.key = d.key AND g.id = d.id AND g.size = d.size
"""

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.node = w.doc_id
"""

#: The others have no SQL: trained models, a graph search, hashed sketches of templates, or dynamic programming decide; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op5_warc": _OP5, "op6_mixing": _OP6, "op7_near_dedup": _OP7}
