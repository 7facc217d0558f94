"""Problem 3: what each scan run must process."""

from __future__ import annotations

from strataloom.catalog import table
from strataloom.operators.incremental import files_to_process


def p3_found(spark, sf_dir):
    return files_to_process(table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "scan_runs"), table(spark, sf_dir, "files"))


P3_SQL = r"""
WITH runs AS (
  SELECT run_id, min(CASE WHEN status = 'ok' THEN started_at END) OVER (PARTITION BY project_id ORDER BY started_at, run_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ok_start, project_id
  FROM scan_runs),
cover AS (
  SELECT a.run_id, a.ok_start, b.run_id AS ok_run FROM runs a JOIN scan_runs b ON b.project_id = a.project_id AND b.started_at = a.ok_start AND b.status = 'ok'),
rows_ AS (
  SELECT s.project_id, regexp_replace(replace(s.path, '\', '/'), '^(\./+)+', '') AS path, lower(s.hash) AS hash, observed_at, coalesce(is_deleted, false) AS del, row_id, ok_start, ok_run
  FROM file_scans s JOIN cover c USING (run_id) WHERE error IS NULL AND s.path IS NOT NULL),
last_ AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY project_id, path, ok_run ORDER BY observed_at DESC, row_id DESC) = 1),
steps AS (
  SELECT project_id, path, CAST(NULL AS TIMESTAMP) AS began, CAST(NULL AS BIGINT) AS run_id, updated_at AS observed_at, lower(hash) AS hash, false AS del FROM files
  UNION ALL SELECT project_id, path, ok_start, ok_run, observed_at, hash, del FROM last_),
marked AS (
  SELECT *, max(observed_at) OVER (PARTITION BY project_id, path ORDER BY began NULLS FIRST, run_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM steps),
counted AS (SELECT * FROM marked WHERE run_id IS NULL OR seen IS NULL OR observed_at > seen),
known AS (
  SELECT *, lag(CASE WHEN NOT del THEN hash END) OVER (PARTITION BY project_id, path ORDER BY began NULLS FIRST, run_id NULLS FIRST) AS known_hash FROM counted)
SELECT run_id, project_id, path FROM known WHERE run_id IS NOT NULL AND NOT del AND (known_hash IS NULL OR hash IS DISTINCT FROM known_hash)
"""
