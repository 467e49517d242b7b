"""Registry of the core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import drift, nested
from quirespark.plans import evidence, files, geometry, ledger, quality, report, signals, tabular


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return nested.shred(_t(s, d, "job_records").select("record_id", "record_json"))


QUERIES: dict = {
    "p3_found": lambda s, d: nested.page_warnings(_t(s, d, "job_records")),
    "p3_nodes": lambda s, d: _nodes(s, d).select("record_id", "label", "parent", "table", "ordinal", "map_key", F.to_json("fields").alias("fields")),
    "p3_pages": lambda s, d: nested.table(_nodes(s, d), "pages", ("page_id", "page_number", "disposition", "selected_attempt", "source_sha256", "review.reviewer")),
    "p3_attempts": lambda s, d: nested.table(_nodes(s, d), "pages.attempts", ("attempt_id", "stage", "outcome", "format", "raw_sha256", "classification.type", "classification.confidence", "usage.pages", "usage.tokens", "usage.compute_seconds", "usage.cost_usd", "failure.code", "failure.http_status")),
    "p3_warnings": lambda s, d: nested.table(_nodes(s, d), "pages.attempts.warnings", ("value", "code", "type", "page")),
    "p3_comparisons": lambda s, d: nested.table(_nodes(s, d), "pages.comparisons", ("agreement_ratio",)),
    "p6_found": lambda s, d: drift.found(_t(s, d, "job_files")),
    "p6_unified": lambda s, d: drift.unify(_t(s, d, "job_files")),
}
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN ({0})::JSON[] WHEN 'NULL' THEN [] ELSE CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END END"
_ATTEMPTS, _WARNINGS = _LIST.format("(pg->'attempts')"), _LIST.format("(att->'warnings')")
ORACLES: dict = {
    "p3_found": f"""WITH r AS (SELECT record_id, coalesce(json_extract(record_json, '$.payload'), record_json::JSON) AS o FROM job_records WHERE record_json IS NOT NULL),
 p AS (SELECT record_id, unnest(CASE json_type(o->'pages') WHEN 'ARRAY' THEN (o->'pages')::JSON[] WHEN 'OBJECT' THEN map_values((o->'pages')::MAP(VARCHAR, JSON)) ELSE [] END) AS pg FROM r),
 a AS (SELECT record_id, (pg->>'page_number')::INTEGER AS page_number, l, unnest(generate_series(1, greatest(len(l), 1))) AS i FROM (SELECT *, {_ATTEMPTS} AS l FROM p) q),
 w AS (SELECT record_id, page_number, CASE WHEN len(l) = 0 THEN 0 ELSE i END::INTEGER AS attempt_no, l[i] AS att FROM a)
 SELECT record_id, page_number, attempt_no, CASE WHEN len(v) = 0 THEN 0 ELSE k END::INTEGER AS warning_no FROM (SELECT record_id, page_number, attempt_no, v, unnest(generate_series(1, greatest(len(v), 1))) AS k FROM (SELECT *, {_WARNINGS} AS v FROM w) q) q1""",
    "p6_found": """WITH RECURSIVE lines AS (SELECT producer, file_no, raw_line::JSON AS o FROM job_files WHERE json_valid(raw_line) AND json_type(raw_line::JSON) = 'OBJECT'),
 f(producer, file_no, job, path, v) AS (SELECT producer, file_no, o->>'job_id', e.key, e.value FROM lines, LATERAL json_each(o) e UNION ALL SELECT f.producer, f.file_no, f.job, f.path || '.' || e.key, e.value FROM f, LATERAL json_each(f.v) e WHERE json_type(f.v) = 'OBJECT'),
 leaf AS (SELECT producer, file_no, job, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type, CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' ELSE v::VARCHAR END AS value FROM f WHERE json_type(v) NOT IN ('OBJECT', 'NULL')),
 head AS (SELECT producer, file_no, path, type FROM (SELECT producer, file_no, path, type, count(*) AS n FROM leaf GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY producer, file_no, path ORDER BY n DESC, type) = 1),
 pairs AS (SELECT DISTINCT a.producer, a.file_no FROM lines a JOIN lines b ON a.producer = b.producer AND a.file_no = b.file_no + 1),
 now AS (SELECT h.* FROM head h JOIN pairs USING (producer, file_no)), was AS (SELECT h.producer, h.file_no + 1 AS file_no, path, type FROM head h JOIN pairs p ON p.producer = h.producer AND p.file_no = h.file_no + 1),
 gone AS (SELECT * FROM was ANTI JOIN now USING (producer, file_no, path)), came AS (SELECT * FROM now ANTI JOIN was USING (producer, file_no, path)),
 old AS (SELECT g.producer, g.file_no, g.path, l.job, max(l.value) AS value FROM gone g JOIN leaf l ON l.producer = g.producer AND l.file_no = g.file_no - 1 AND l.path = g.path WHERE l.job IS NOT NULL GROUP BY 1, 2, 3, 4),
 new AS (SELECT c.producer, c.file_no, c.path, l.job, max(l.value) AS value FROM came c JOIN leaf l ON l.producer = c.producer AND l.file_no = c.file_no AND l.path = c.path WHERE l.job IS NOT NULL GROUP BY 1, 2, 3, 4),
 same AS (SELECT o.producer, o.file_no, o.path AS old_field, n.path AS new_field, count(*) AS jobs FROM old o JOIN new n USING (producer, file_no, job) GROUP BY 1, 2, 3, 4 HAVING bool_and(o.value = n.value)),
 renamed AS (SELECT producer, file_no, old_field, new_field FROM same QUALIFY row_number() OVER (PARTITION BY producer, file_no, old_field ORDER BY jobs DESC, new_field) = 1 AND row_number() OVER (PARTITION BY producer, file_no, new_field ORDER BY jobs DESC, old_field) = 1)
 SELECT producer, file_no, 'renamed' AS change_kind, old_field, new_field FROM renamed UNION ALL SELECT producer, file_no, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.producer = g.producer AND r.file_no = g.file_no AND r.old_field = g.path)
 UNION ALL SELECT producer, file_no, 'added', '', path FROM came c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.producer = c.producer AND r.file_no = c.file_no AND r.new_field = c.path)
 UNION ALL SELECT n.producer, n.file_no, 'type_changed', n.path, n.path FROM now n JOIN was w USING (producer, file_no, path) WHERE n.type <> w.type""",
}
for _m in (quality, tabular, ledger, geometry, files, evidence, report, signals):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
