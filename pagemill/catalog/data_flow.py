"""Problems 6 and 7: incremental processing and nested records."""

from pagemill.operators import incremental, nested
from pagemill.session import load, new_folder


def p6_found(spark, d):
    """What the incremental job publishes when it catches up with all attempts of the log."""
    job = incremental.IncrementalJob(spark, new_folder(spark))
    incremental.catch_up(job, load(spark, d, "crawl_pages"), load(spark, d, "process_runs"))
    got = job.read()
    return spark.createDataFrame([], "proc_id bigint, page_id bigint") if got is None else got


def p7_found(spark, d):
    rows = nested.bridge(load(spark, d, "page_structured_json"))
    return nested.occurrences(rows).select("page_id", "node_path", "parent_path")


def p7_objects(spark, d):
    rows = nested.bridge(load(spark, d, "page_structured_json"))
    return nested.objects(rows)


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_objects": p7_objects}

SQL = {
    "p6_found": """
WITH r AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY stored_at, started) AS k
    FROM crawl_pages WHERE status = 'Success' AND stored_at IS NOT NULL AND page_id IS NOT NULL
  ) WHERE k = 1
), p AS (
  SELECT *, lag(page_id) OVER w AS prev_id, lag(entity_tag) OVER w AS prev_tag, lag(last_modified) OVER w AS prev_date
  FROM r WINDOW w AS (PARTITION BY url ORDER BY started, page_id)
), c AS (
  SELECT page_id, stored_at FROM p
  WHERE prev_id IS NULL OR CASE
    WHEN response_changed IS NOT NULL THEN response_changed
    WHEN nullif(trim(entity_tag), '') IS NOT NULL AND nullif(trim(prev_tag), '') IS NOT NULL
      THEN regexp_replace(trim(entity_tag), '^W/', '') <> regexp_replace(trim(prev_tag), '^W/', '')
    WHEN last_modified IS NOT NULL AND prev_date IS NOT NULL THEN last_modified <> prev_date
    ELSE true END
)
SELECT proc_id, page_id FROM (
  SELECT c.page_id, s.proc_id, row_number() OVER (PARTITION BY c.page_id ORDER BY s.started, s.proc_id) AS k
  FROM c JOIN process_runs s ON s.proc_state = 'succeeded' AND s.started > c.stored_at
) WHERE k = 1""",
    "p7_found": """
WITH RECURSIVE raw AS (
  SELECT DISTINCT page_id, CAST(structured_json AS JSON) AS v FROM page_structured_json WHERE json_valid(structured_json)
), one AS (
  SELECT page_id, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) ELSE v END AS v FROM raw
), two AS (
  SELECT page_id, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) ELSE v END AS v FROM one
), walk(page_id, path, owner, above, v, node) AS (
  SELECT page_id, '', '', '', v, false FROM two WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT page_id, c.path, CASE WHEN node_here THEN c.path ELSE owner END, owner, c.v, node_here FROM (
    SELECT page_id, owner, c, json_type(v) = 'ARRAY' AND json_type(c.v) = 'OBJECT' AS node_here FROM (
      SELECT page_id, owner, v, unnest(CASE json_type(v)
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {'path': path || '[' || i || ']', 'v': json_extract(v, '$[' || i || ']')})
        ELSE list_transform(json_keys(v), lambda k: {
          'path': CASE WHEN path = '' THEN '' ELSE path || '.' END || upper(k[1]) || k[2:],
          'v': CASE WHEN upper(k[1]) || k[2:] IN ('MetaTags','Regions','Breadcrumbs','Items','FaqItems','SpecTables','Entries','CodeBlocks','Callouts','ApiEndpoints','Parameters','RequestExamples','ResponseExamples','Headers','BodyFields','Forms','Fields','Tables','Data')
            THEN CASE json_type(json_extract(v, '$."' || k || '"'))
              WHEN 'OBJECT' THEN json_array(json_extract(v, '$."' || k || '"'))
              WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$."' || k || '"')) THEN
                CASE json_type(json_extract_string(v, '$."' || k || '"')) WHEN 'OBJECT' THEN json_array(CAST(json_extract_string(v, '$."' || k || '"') AS JSON)) WHEN 'ARRAY' THEN CAST(json_extract_string(v, '$."' || k || '"') AS JSON) END END
              ELSE json_extract(v, '$."' || k || '"') END
            ELSE json_extract(v, '$."' || k || '"') END})
        END) AS c FROM walk)
  ) WHERE json_type(c.v) IN ('OBJECT', 'ARRAY')
)
SELECT DISTINCT page_id, path AS node_path, above AS parent_path FROM walk WHERE node""",
}
