"""DuckDB SQL for every registered query (the correctness oracle).

The derived inputs reuse the derivation expressions of
``scorecraft.plans.derived`` (plain SQL both engines evaluate alike); the
query logic on top is written independently with DuckDB's JSON functions,
window functions and set operations.
"""

from __future__ import annotations

from scorecraft.plans import derived as D

EVALUATIONS_CTE = f"""
ev_src AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {D._DOC_INFO_SQL} AS doc_info
  FROM orders
),
ev AS (
  SELECT o_orderkey AS eval_id, o_orderstatus AS model, o_orderpriority AS source,
         o_orderpriority AS case_id, o_orderkey + 1 AS row_index,
         {D._TRUTH_SQL} AS ground_truth,
         {D._OUTPUT_SQL} AS llm_output,
         {D._ERROR_KIND_SQL} AS error_kind
  FROM ev_src
)"""

# Python == on JSON values: numbers compare by value across int/float and
# bool; everything else by its minified JSON text.
_NUMERIC = "('BIGINT','UBIGINT','DOUBLE','BOOLEAN')"


def _json_eq(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL THEN false "
        f"WHEN json_type({a}) IN {_NUMERIC} AND json_type({b}) IN {_NUMERIC} "
        f"THEN (CASE WHEN json_type({a}) = 'BOOLEAN' THEN (CASE WHEN {a}::VARCHAR = 'true' THEN 1.0 ELSE 0.0 END) ELSE {a}::DOUBLE END) = "
        f"(CASE WHEN json_type({b}) = 'BOOLEAN' THEN (CASE WHEN {b}::VARCHAR = 'true' THEN 1.0 ELSE 0.0 END) ELSE {b}::DOUBLE END) "
        f"ELSE {a}::VARCHAR = {b}::VARCHAR END)"
    )


_KEY_PATH = "'$.\"' || k || '\"'"
SCORED_CTE = f"""
sc0 AS (
  SELECT ev.*,
         coalesce(json_valid(llm_output) AND (CASE WHEN json_valid(llm_output) THEN json_type(llm_output) END) = 'OBJECT', false) AS pred_ok,
         len(json_keys(ground_truth)) AS n_t
  FROM ev
),
sc1 AS (
  SELECT sc0.*,
         CASE WHEN pred_ok THEN len(json_keys(llm_output)) ELSE 0 END AS n_p,
         CASE WHEN pred_ok THEN len(list_filter(json_keys(ground_truth), lambda k:
              {_json_eq(f"json_extract(llm_output, {_KEY_PATH})", f"json_extract(ground_truth, {_KEY_PATH})")}))
              ELSE 0 END AS m
  FROM sc0
),
sc AS (
  SELECT sc1.*,
         CASE WHEN n_t = 0 THEN (CASE WHEN n_p = 0 THEN 1.0 ELSE 0.0 END) ELSE m / greatest(n_t, n_p) END AS strict_score,
         CASE WHEN n_t = 0 THEN 0.0 ELSE m / n_t END AS partial,
         (n_t > 0 AND n_p = n_t AND m = n_t) AS exact,
         n_t > 0 AS has_truth,
         NOT pred_ok AS parse_error,
         CASE WHEN json_type(ground_truth, '$.document_info') = 'OBJECT' THEN coalesce(
           nullif(regexp_replace(lower(regexp_replace(
             regexp_extract(regexp_extract(coalesce(trim(json_extract_string(ground_truth, '$.document_info.filename')), ''),
                                           '([^/]*)$', 1), '^.+?(\\.[^.]+)$', 1),
             '^\\.+', '')), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), ''),
           nullif(trim(json_extract_string(ground_truth, '$.document_info.source_type')), ''),
           'unknown') ELSE 'unknown' END AS category
  FROM sc1
)"""

_SUMMARY = """CAST(count(*) AS BIGINT) AS total_evaluations,
  CAST(count(*) FILTER (WHERE has_truth) AS BIGINT) AS ground_truth_count,
  CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS exact_match_count,
  round(sum(partial), 6) AS partial_score_sum,
  CAST(count(*) FILTER (WHERE parse_error) AS BIGINT) AS error_count,
  round(CASE WHEN count(*) FILTER (WHERE has_truth) > 0
        THEN count(*) FILTER (WHERE exact) / count(*) FILTER (WHERE has_truth) * 100.0 ELSE 0.0 END, 6) AS exact_accuracy_percent,
  round(CASE WHEN count(*) FILTER (WHERE has_truth) > 0
        THEN sum(partial) / count(*) FILTER (WHERE has_truth) * 100.0 ELSE 0.0 END, 6) AS partial_accuracy_percent"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


SQL: dict[str, str] = {}

SQL["strict_accuracy"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT eval_id, model, source, round(strict_score, 6) AS strict_score, parse_error FROM sc"""

SQL["partial_exact"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT eval_id, exact, round(partial, 6) AS partial_score, parse_error FROM sc"""

SQL["category_accuracy"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT 'overall' AS scope, 'overall' AS name, {_SUMMARY} FROM sc
UNION ALL
SELECT 'category' AS scope, category AS name, {_SUMMARY} FROM sc GROUP BY category"""

SQL["accuracy_scopes"] = SQL["category_accuracy"] + f"""
UNION ALL
SELECT 'model' AS scope, model AS name, {_SUMMARY} FROM sc GROUP BY model
UNION ALL
SELECT 'source' AS scope, source AS name, {_SUMMARY} FROM sc GROUP BY source"""

SQL["category_label"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT eval_id, category FROM sc"""

# --- runs from evaluations (U1, A1, A2) --------------------------------------

_REPORT_ROWS = """
ab AS (
  SELECT model, case_id, min(row_index) FILTER (WHERE error_kind = 'auth') AS abort_at
  FROM ev GROUP BY model, case_id
),
kept AS (
  SELECT sc.*, ab.abort_at FROM sc JOIN ab USING (model, case_id)
  WHERE ab.abort_at IS NULL OR sc.row_index < ab.abort_at
)"""

SQL["run_summary"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT model, case_id, 'completed' AS status, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE error_kind IS NULL) AS BIGINT) AS successful_evaluations,
       round(sum(CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END) / count(*), 6) AS average_score
FROM sc GROUP BY model, case_id"""

_DATASET_RUNS = """dataset_runs AS (
  SELECT r.model, r.case_id, 'completed' AS status,
    CAST((SELECT count(*) FROM sc d WHERE d.case_id = r.case_id) AS BIGINT) AS total_rows, r.ok AS successful_evaluations,
    r.total / (SELECT count(*) FROM sc d WHERE d.case_id = r.case_id) AS average_score
  FROM (
    SELECT model, case_id, CAST(count(*) FILTER (WHERE error_kind IS NULL) AS BIGINT) AS ok,
      sum(CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END) AS total
    FROM sc GROUP BY model, case_id) r)"""

SQL["evaluate_dataset"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _DATASET_RUNS)}
SELECT model, case_id, status, total_rows, successful_evaluations, round(average_score, 6) AS average_score FROM dataset_runs"""

SQL["generated_reports"] = """
WITH rows AS (
  SELECT m.model, role AS case_id, conv_id * 1000 + turn + 1 AS row_index, turn, length(coalesce(text, '')) AS n
  FROM conversations, (VALUES ('model-a'), ('model-b')) m(model)),
answered AS (
  SELECT *, model = 'model-b' AND n % 101 = 7 AS auth, n % 17 = 3 AS limited, n % 19 = 5 AS failed,
    n % 5 = 2 AS junk, n % 23 = 1 AS again FROM rows),
aborts AS (SELECT model, case_id, min(row_index) FILTER (auth) AS abort_at FROM answered GROUP BY model, case_id),
kept AS (
  SELECT a.* FROM answered a JOIN aborts b USING (model, case_id) WHERE b.abort_at IS NULL OR a.row_index < b.abort_at)
SELECT model, case_id, row_index, CASE WHEN limited OR failed THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN limited OR failed OR junk THEN 0.0 WHEN model = 'model-b' AND turn = 0 THEN 1.0 ELSE 0.5 END AS score,
  CASE WHEN limited OR failed THEN '' WHEN junk THEN 'no object'
    ELSE '{"chars":' || n || CASE WHEN model = 'model-b' THEN ',"turn":0' ELSE '' END || '}' END AS llm_output,
  CASE WHEN limited THEN 'too many requests' WHEN failed THEN 'no answer of ' || n || ' characters' ELSE '' END AS error_message,
  CASE WHEN limited OR again THEN 2 ELSE 1 END AS attempts
FROM kept
"""

SQL["failed_preprocess"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _DATASET_RUNS)},
broken AS (SELECT case_id FROM sc GROUP BY case_id HAVING count(*) % 2 = 1)
SELECT d.model, d.case_id, CASE WHEN b.case_id IS NULL THEN d.status ELSE 'failed_preprocess' END AS status,
  CASE WHEN b.case_id IS NULL THEN total_rows ELSE 0 END AS total_rows,
  CASE WHEN b.case_id IS NULL THEN successful_evaluations ELSE 0 END AS successful_evaluations,
  CASE WHEN b.case_id IS NULL THEN round(average_score, 6) ELSE 0.0 END AS average_score,
  CASE WHEN b.case_id IS NOT NULL THEN 'cannot read ' || d.case_id END AS error_message
FROM dataset_runs d LEFT JOIN broken b ON d.case_id = b.case_id"""

SQL["run_summary_abort"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS)},
agg AS (
  SELECT model, case_id, count(*) AS n, count(*) FILTER (WHERE error_kind IS NULL) AS ok,
         sum(CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END) AS s
  FROM kept GROUP BY model, case_id
)
SELECT ab.model, ab.case_id,
       CASE WHEN ab.abort_at IS NOT NULL THEN 'aborted_due_to_auth' ELSE 'completed' END AS status,
       CAST(CASE WHEN ab.abort_at IS NOT NULL THEN ab.abort_at ELSE agg.n END AS BIGINT) AS total_rows,
       CAST(coalesce(agg.ok, 0) AS BIGINT) AS successful_evaluations,
       round(CASE WHEN ab.abort_at IS NOT NULL
                  THEN (CASE WHEN coalesce(agg.ok, 0) > 0 THEN agg.s / agg.ok ELSE 0.0 END)
                  ELSE agg.s / agg.n END, 6) AS average_score
FROM ab LEFT JOIN agg USING (model, case_id)"""

SQL["row_truths"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT eval_id, CASE WHEN pred_ok THEN llm_output ELSE
  '{{"case_id":"' || case_id || '","row_index":' || CAST(row_index AS VARCHAR) || ',"error_kind":' ||
  coalesce('"' || error_kind || '"', 'null') || '}}' END AS truth
FROM sc"""

SQL["success_fractions"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE)}
SELECT model, case_id, CAST(count(*) FILTER (WHERE error_kind IS NULL) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS fraction
FROM sc GROUP BY model, case_id"""

SQL["report_rows"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS)}
SELECT model, case_id, row_index,
       CASE WHEN error_kind IS NULL THEN 'completed' ELSE 'failed' END AS status,
       round(CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END, 6) AS score,
       CASE WHEN error_kind IS NULL THEN llm_output ELSE '' END AS llm_output,
       CASE WHEN error_kind IS NULL THEN ''
            ELSE 'generation failed for row ' || CAST(row_index AS VARCHAR) END AS error_message
FROM kept"""

# --- runs from events (A4-A8) -------------------------------------------------

RUNS_CTE = f"""
runs0 AS (
  SELECT event_type AS model, 'case_' || CAST(user_id AS VARCHAR) AS case_id, {D._STATUS_SQL} AS status,
         least(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10), 8) / 8.0 AS score0,
         CAST(floor(value / 10) AS DOUBLE) AS seconds0, event_id AS run_index
  FROM events
),
runs AS (
  SELECT model, case_id, status,
         CASE WHEN status IN ('empty', 'failed_preprocess') THEN 0.0 ELSE score0 END AS average_score,
         CASE WHEN status = 'failed_preprocess' THEN 0.0 ELSE seconds0 END AS elapsed_seconds,
         run_index
  FROM runs0
)"""


def _case_rows(src: str, name: str) -> str:
    return f"""
{name}_best AS (
  SELECT case_id, model AS best_model, average_score AS best_score,
         row_number() OVER (PARTITION BY case_id ORDER BY average_score DESC, elapsed_seconds ASC, run_index ASC) AS rn
  FROM {src}
),
{name}_fast AS (
  SELECT case_id, model AS fastest_model, elapsed_seconds AS fastest_seconds,
         row_number() OVER (PARTITION BY case_id ORDER BY elapsed_seconds ASC, average_score DESC, run_index ASC) AS rn
  FROM {src}
),
{name} AS (
  SELECT c.case_id, b.best_model, b.best_score, f.fastest_model, f.fastest_seconds,
         CAST(c.total_runs AS BIGINT) AS total_runs, CAST(c.completed_runs AS BIGINT) AS completed_runs
  FROM (SELECT case_id, count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed_runs
        FROM {src} GROUP BY case_id) c
  JOIN {name}_best b ON b.case_id = c.case_id AND b.rn = 1
  JOIN {name}_fast f ON f.case_id = c.case_id AND f.rn = 1
)"""


def _model_rows(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT model, avg(average_score) AS average_score, avg(elapsed_seconds) AS average_seconds,
         CAST(count(*) AS BIGINT) AS total_runs,
         CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed_runs,
         min(run_index) AS first_run
  FROM {src} GROUP BY model
)"""


def _winner_rows(models: str, tie: str) -> str:
    return f"""
SELECT section, model, average_score, average_seconds, total_runs, completed_runs FROM (
  SELECT 'overall_best_average' AS section, model, average_score, average_seconds, total_runs, completed_runs,
         row_number() OVER (ORDER BY average_score DESC, average_seconds ASC, {tie} ASC) AS rn FROM {models}
  UNION ALL
  SELECT 'overall_fastest' AS section, model, average_score, average_seconds, total_runs, completed_runs,
         row_number() OVER (ORDER BY average_seconds ASC, average_score DESC, {tie} ASC) AS rn FROM {models}
) w WHERE rn = 1"""


def _layout(kind: str, src: str) -> str:
    if kind == "case":
        return f"""SELECT 'case_comparison' AS section, case_id, CAST(NULL AS VARCHAR) AS model, best_model,
  round(best_score, 6) AS best_score, fastest_model, round(fastest_seconds, 6) AS fastest_seconds,
  CAST(NULL AS DOUBLE) AS average_score, CAST(NULL AS DOUBLE) AS average_seconds, total_runs, completed_runs FROM {src}"""
    if kind == "model":
        return f"""SELECT 'model_summary' AS section, CAST(NULL AS VARCHAR) AS case_id, model,
  CAST(NULL AS VARCHAR) AS best_model, CAST(NULL AS DOUBLE) AS best_score, CAST(NULL AS VARCHAR) AS fastest_model,
  CAST(NULL AS DOUBLE) AS fastest_seconds, round(average_score, 6) AS average_score,
  round(average_seconds, 6) AS average_seconds, total_runs, completed_runs FROM {src}"""
    return f"""SELECT section, CAST(NULL AS VARCHAR) AS case_id, model,
  CAST(NULL AS VARCHAR) AS best_model, CAST(NULL AS DOUBLE) AS best_score, CAST(NULL AS VARCHAR) AS fastest_model,
  CAST(NULL AS DOUBLE) AS fastest_seconds, round(average_score, 6) AS average_score,
  round(average_seconds, 6) AS average_seconds, total_runs, completed_runs FROM ({src}) ww"""


SQL["case_comparison"] = f"""{_with(RUNS_CTE, _case_rows('runs', 'cases'))}
SELECT case_id, best_model, round(best_score, 6) AS best_score, fastest_model,
       round(fastest_seconds, 6) AS fastest_seconds, total_runs, completed_runs FROM cases"""

SQL["model_summary"] = f"""{_with(RUNS_CTE, _model_rows('runs', 'models'))}
SELECT model, round(average_score, 6) AS average_score, round(average_seconds, 6) AS average_seconds,
       total_runs, completed_runs FROM models"""

SQL["overall_winners"] = f"""{_with(RUNS_CTE, _model_rows('runs', 'models'))}
SELECT section, model, round(average_score, 6) AS average_score, round(average_seconds, 6) AS average_seconds,
       total_runs, completed_runs FROM ({_winner_rows('models', 'first_run')}) x"""

SQL["overall_report"] = f"""{_with(RUNS_CTE, _case_rows('runs', 'cases'), _model_rows('runs', 'models'))}
{_layout('case', 'cases')}
UNION ALL
{_layout('model', 'models')}
UNION ALL
{_layout('winners', _winner_rows('models', 'first_run'))}"""

_SPLIT = """
mid AS (SELECT (max(event_id) + 1) / 2 AS m FROM events),
base_runs AS (SELECT runs.* FROM runs, mid WHERE run_index < mid.m),
new_runs AS (SELECT runs.* FROM runs, mid WHERE run_index >= mid.m)"""

_MERGED = f"""
merged_cases AS (
  SELECT * FROM new_cases
  UNION ALL
  SELECT * FROM base_cases b WHERE NOT EXISTS (SELECT 1 FROM new_cases n WHERE n.case_id = b.case_id)
),
merged_models AS (
  SELECT coalesce(n.model, b.model) AS model,
         CASE WHEN b.model IS NOT NULL AND n.model IS NOT NULL THEN
              (CASE WHEN b.total_runs + n.total_runs = 0 THEN 0.0
                    ELSE (b.average_score * b.total_runs + n.average_score * n.total_runs) / (b.total_runs + n.total_runs) END)
              ELSE coalesce(n.average_score, b.average_score) END AS average_score,
         CASE WHEN b.model IS NOT NULL AND n.model IS NOT NULL THEN
              (CASE WHEN b.total_runs + n.total_runs = 0 THEN 0.0
                    ELSE (b.average_seconds * b.total_runs + n.average_seconds * n.total_runs) / (b.total_runs + n.total_runs) END)
              ELSE coalesce(n.average_seconds, b.average_seconds) END AS average_seconds,
         CAST(coalesce(b.total_runs, 0) + coalesce(n.total_runs, 0) AS BIGINT) AS total_runs,
         CAST(coalesce(b.completed_runs, 0) + coalesce(n.completed_runs, 0) AS BIGINT) AS completed_runs
  FROM base_models b FULL OUTER JOIN new_models n ON b.model = n.model
)"""

SQL["merge_overall"] = f"""{_with(RUNS_CTE, _SPLIT, _case_rows('base_runs', 'base_cases'), _case_rows('new_runs', 'new_cases'),
                                 _model_rows('base_runs', 'base_models'), _model_rows('new_runs', 'new_models'), _MERGED)}
{_layout('case', 'merged_cases')}
UNION ALL
{_layout('model', 'merged_models')}
UNION ALL
{_layout('winners', _winner_rows('merged_models', 'model'))}"""

SQL["merge_cases"] = f"""{_with(RUNS_CTE, _SPLIT, _case_rows('base_runs', 'base_cases'), _case_rows('new_runs', 'new_cases'),
                                _model_rows('base_runs', 'base_models'), _model_rows('new_runs', 'new_models'), _MERGED)}
SELECT case_id, best_model, round(best_score, 6) AS best_score, fastest_model,
       round(fastest_seconds, 6) AS fastest_seconds, total_runs, completed_runs FROM merged_cases"""

# --- per-source scores (A9, J7, J8) -------------------------------------------

_EVAL_RUNS = """
agg AS (
  SELECT model, case_id, count(*) AS n, count(*) FILTER (WHERE error_kind IS NULL) AS ok,
         sum(CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END) AS s
  FROM kept GROUP BY model, case_id
),
eruns AS (
  SELECT ab.model, ab.case_id,
         CASE WHEN ab.abort_at IS NOT NULL THEN 'aborted_due_to_auth' ELSE 'completed' END AS status,
         CASE WHEN ab.abort_at IS NOT NULL THEN (CASE WHEN coalesce(agg.ok, 0) > 0 THEN agg.s / agg.ok ELSE 0.0 END)
              ELSE agg.s / agg.n END AS average_score,
         CAST(CASE WHEN ab.abort_at IS NOT NULL THEN ab.abort_at ELSE agg.n END AS DOUBLE) AS elapsed_seconds,
         CAST(CASE WHEN ab.abort_at IS NOT NULL THEN ab.abort_at ELSE agg.n END AS BIGINT) AS run_index
  FROM ab LEFT JOIN agg USING (model, case_id)
),
f1 AS (
  SELECT model, source, CASE WHEN error_kind IS NULL THEN strict_score ELSE 0.0 END AS score
  FROM kept WHERE error_kind IS NULL AND trim(llm_output) <> '' AND model IS NOT NULL AND trim(model) <> ''
)"""

_PIVOT = ",\n".join(
    f"round(avg(score) FILTER (WHERE source = '{p}'), 6) AS \"{p}\""
    for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
)

SQL["source_scores"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS, _EVAL_RUNS)}
SELECT model, round(avg(score), 6) AS source_score FROM f1 WHERE source = '1-URGENT' GROUP BY model"""

SQL["source_column"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS, _EVAL_RUNS, _model_rows('eruns', 'models'))},
piv AS (SELECT model, {_PIVOT} FROM f1 GROUP BY model)
SELECT m.model, round(m.average_score, 6) AS average_score, round(m.average_seconds, 6) AS average_seconds,
       m.total_runs, m.completed_runs, p."1-URGENT", p."2-HIGH", p."3-MEDIUM", p."4-NOT SPECIFIED", p."5-LOW"
FROM models m LEFT JOIN piv p USING (model)"""

SQL["source_winners"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS, _EVAL_RUNS, _model_rows('eruns', 'models'))},
src AS (SELECT model, avg(score) AS s FROM f1 WHERE source = '1-URGENT' GROUP BY model),
w AS ({_winner_rows('models', 'first_run')})
SELECT w.section, w.model, round(w.average_score, 6) AS average_score, round(w.average_seconds, 6) AS average_seconds,
       w.total_runs, w.completed_runs,
       round(CASE WHEN w.section = 'overall_fastest' THEN NULL ELSE src.s END, 6) AS "1-URGENT"
FROM w LEFT JOIN src USING (model)"""

_SOURCES_OF = ", ".join(
    f"round(CASE WHEN r.section = 'overall_fastest' THEN NULL ELSE p.\"{c}\" END, 6) AS \"{c}\""
    for c in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
)

SQL["source_report"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _REPORT_ROWS, _EVAL_RUNS, _model_rows('eruns', 'models'))},
piv AS (SELECT model, {_PIVOT} FROM f1 GROUP BY model),
w AS ({_winner_rows('models', 'first_run')}),
r AS (
  SELECT 'model_summary' AS section, model, average_score, average_seconds, total_runs, completed_runs FROM models
  UNION ALL SELECT section, model, average_score, average_seconds, total_runs, completed_runs FROM w)
SELECT r.section, r.model, round(r.average_score, 6) AS average_score, round(r.average_seconds, 6) AS average_seconds,
  r.total_runs, r.completed_runs, {_SOURCES_OF}
FROM r LEFT JOIN piv p USING (model)"""

# The truth of a run's rows is that of its first row.
SQL["stored_accuracy"] = f"""{_with(EVALUATIONS_CTE.replace("ev AS (", "ev_all AS ("), f"""
ev AS (SELECT * FROM (
  SELECT * REPLACE (first_value(ground_truth) OVER (PARTITION BY {D.STORED_CASE_SQL} ORDER BY row_index) AS ground_truth)
  FROM ev_all WHERE model = 'F' AND source = '1-URGENT') WHERE error_kind IS NULL)""", SCORED_CTE)}
SELECT 'overall' AS scope, 'overall' AS name, {_SUMMARY} FROM sc
UNION ALL SELECT 'category', category, {_SUMMARY} FROM sc GROUP BY category
UNION ALL SELECT 'model', model, {_SUMMARY} FROM sc GROUP BY model
UNION ALL SELECT 'source', source, {_SUMMARY} FROM sc GROUP BY source"""

SQL["extracted_archives"] = f"""
WITH s AS (SELECT {D.ARCHIVE_SQL['supplier']} AS g, * FROM supplier), p AS (SELECT {D.ARCHIVE_SQL['part']} AS g, * FROM part),
c AS (
  SELECT {D.ARCHIVE_SQL['customer']} AS g, upper(string_agg(c_name || '/', '' ORDER BY c_custkey)) AS names FROM customer GROUP BY 1)
SELECT 'suppliers_' || g || '.docx' AS file, 'Suppliers ' || g || chr(10) || 'supplier' || chr(9) || 'supplier' || chr(9) || 'nation' || chr(10)
  || string_agg(s_suppkey || chr(9) || s_name || chr(9) || s_nationkey, chr(10) ORDER BY s_suppkey) AS text, CAST(NULL AS VARCHAR) AS error
FROM s GROUP BY g
UNION ALL
SELECT 'parts_' || g || '.XLSX', 'SHEET: Parts' || chr(10) || string_agg(p_partkey || chr(9) || chr(9) || p_brand, chr(10) ORDER BY p_partkey)
  || chr(10) || 'SHEET: Sizes' || chr(10) || string_agg(chr(9) || 'size ' || p_size, chr(10) ORDER BY p_partkey), NULL FROM p GROUP BY g
UNION ALL
SELECT 'customers_' || g || '.rec', CASE WHEN g % 3 <> 1 THEN names END, CASE WHEN g % 3 = 1 THEN 'no record' END FROM c
UNION ALL
SELECT 'notes_' || g || '.gif', NULL, 'Unsupported file format for extraction: .gif.' FROM c"""

# --- recommendations (R2, X1, X2, X4) -----------------------------------------

_CAT_SCORES = """
cat AS (
  SELECT category,
         CASE WHEN count(*) FILTER (WHERE has_truth) > 0
              THEN count(*) FILTER (WHERE exact) / count(*) FILTER (WHERE has_truth) * 100.0 ELSE 0.0 END AS pct
  FROM sc GROUP BY category
),
cs AS (SELECT category, greatest(0.0, least(1.0, pct / 100.0)) AS score FROM cat)"""

SQL["recommendations"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _CAT_SCORES)}
SELECT category, round(score, 6) AS score, round(greatest(0.0, 0.70 - score), 6) AS gap,
       CAST(row_number() OVER (ORDER BY score ASC, category ASC) AS INTEGER) AS position
FROM cs WHERE score < 0.70"""

SQL["recommendation_state"] = f"""{_with(EVALUATIONS_CTE, SCORED_CTE, _CAT_SCORES)}
SELECT CASE WHEN count(*) = 0 THEN 'no_data'
            WHEN count(*) FILTER (WHERE score < 1.0) = 0 THEN 'max_performance'
            WHEN count(*) FILTER (WHERE score < 0.70) = 0 THEN 'none_low'
            ELSE 'ranked' END AS state,
       CAST(count(*) AS BIGINT) AS categories,
       CAST(count(*) FILTER (WHERE score < 0.70) AS BIGINT) AS below_threshold
FROM cs"""

# --- cases (S7, J1-J3, F5, A14) -------------------------------------------------

_LISTING = f"""
listing AS (
  SELECT path FROM (
    SELECT {D.PART_LISTING_SQL['input']} AS path FROM part
    UNION ALL SELECT {D.PART_LISTING_SQL['out_ext']} FROM part
    UNION ALL SELECT {D.PART_LISTING_SQL['out_plain']} FROM part
  ) WHERE path IS NOT NULL
),
inp AS (
  SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
         regexp_extract(path, '([^/]*)$', 1) AS name
  FROM listing WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^.*_input\\..*$')
),
inp2 AS (
  SELECT *, regexp_extract(name, '^.+?(\\.[^.]+)$', 1) AS suffix FROM inp
),
inp3 AS (
  SELECT *, lower(suffix) AS ext,
         regexp_replace(left(name, length(name) - length(suffix)), '_input$', '') AS prefix
  FROM inp2
),
paired AS (
  SELECT i.path, i.dir, i.prefix, i.ext, i.suffix,
         coalesce(a.path, b.path) AS output_path
  FROM inp3 i
  LEFT JOIN (SELECT DISTINCT path FROM listing) a
    ON a.path = i.dir || '/' || i.prefix || '_' || substr(i.ext, 2) || '_output.csv'
  LEFT JOIN (SELECT DISTINCT path FROM listing) b
    ON b.path = i.dir || '/' || i.prefix || '_output.csv'
)"""

_SUPPORTED = "('.csv', '.docx', '.pdf', '.png', '.txt', '.xlsx')"

SQL["pair_cases"] = f"""{_with(_LISTING)}
SELECT regexp_replace(regexp_extract(dir, '([^/]*)$', 1), '\\.', '_', 'g') || '__' || prefix AS case_id,
       path AS input_path, output_path
FROM paired WHERE ext IN {_SUPPORTED} AND output_path IS NOT NULL"""

SQL["skipped_cases"] = f"""{_with(_LISTING)}
SELECT path AS input_path, 'unsupported input format ' || suffix AS reason FROM paired WHERE ext NOT IN {_SUPPORTED}
UNION ALL
SELECT path AS input_path, 'matching *_output.csv file was not found' AS reason
FROM paired WHERE ext IN {_SUPPORTED} AND output_path IS NULL"""

SQL["run_matrix"] = """WITH
m AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS mpos
      FROM (SELECT DISTINCT event_type AS model FROM events)),
c AS (SELECT 'suppliers_v1__' || s_name AS case_id, 'suppliers.v1/' || s_name || '_input.pdf' AS input_path FROM supplier),
cp AS (SELECT case_id, row_number() OVER (ORDER BY input_path) - 1 AS cpos FROM c),
n AS (SELECT count(*) AS n FROM supplier)
SELECT m.model, cp.case_id, CAST(m.mpos * n.n + cp.cpos + 1 AS BIGINT) AS run_index
FROM m CROSS JOIN cp CROSS JOIN n"""

SQL["expected_output"] = f"""WITH
tr AS (SELECT {', '.join(f"{v} AS {k}" for k, v in D.TRUTH_ROW_SQL.items())} FROM lineitem),
cs AS (SELECT {', '.join(f"{v} AS {k}" for k, v in D.ORDER_CASE_SQL.items())} FROM orders),
g AS (
  SELECT case_id, count(*) AS n,
         to_json(list(json_object('unit', unit, 'item', item, 'num_type', num_type,
                                  'status_type', status_type, 'value', value)
                      ORDER BY row_pos, unit, item, num_type, status_type, value)) AS rows_json
  FROM tr GROUP BY case_id
)
SELECT cs.case_id, CAST(coalesce(g.n, 0) AS INTEGER) AS total_rows,
       CAST(json_object(
         'document_info', json_object(
            'source_type', CASE WHEN lower(regexp_extract(input_path, '\\.([^./]+)$', 1)) IN ('pdf', 'png') THEN 'PDF' ELSE 'Excel' END,
            'filename', regexp_extract(input_path, '([^/]*)$', 1)),
         'summary', json_object('total_sheets', 1, 'total_rows', coalesce(g.n, 0), 'total_columns', 5),
         'content_data', json_array(json_object(
            'table_name', 'Sheet1',
            'headers', json_array('unit', 'item', 'num_type', 'status_type', 'value'),
            'rows', coalesce(g.rows_json, '[]'::JSON)))) AS VARCHAR) AS expected_output
FROM cs LEFT JOIN g USING (case_id)"""

# --- names and labels (M10-M14) -------------------------------------------------


def _safe_segment(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({x}, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'unnamed')"


def _safe_label(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_'), ''), 'all')"


SQL["safe_names"] = f"""WITH p AS (
  SELECT *, string_split(replace(concat_ws(' ', p_name, p_type), ' ', '__'), '__') AS parts FROM part
)
SELECT p_partkey,
       {_safe_segment("concat_ws('/', p_brand, p_name)")} AS segment,
       {_safe_label("concat_ws(' ', p_brand, p_name)")} AS label,
       CASE WHEN len(parts) >= 2 THEN parts[1] END AS model,
       CASE WHEN len(parts) >= 2 THEN parts[2] END AS source,
       CASE WHEN p_size % 3 = 0 THEN 'PDF' ELSE 'Excel' END AS source_type
FROM p"""

SQL["url_labels"] = f"""WITH u AS (
  SELECT page_id, url, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name,
         regexp_extract(url, '([^/]*)/[^/]*$', 1) AS parent FROM pages
), u2 AS (
  SELECT *, regexp_extract(name, '^.+?(\\.[^.]+)$', 1) AS suffix FROM u
)
SELECT page_id,
       regexp_replace(parent, '\\.', '_', 'g') || '__' ||
         regexp_replace(left(name, length(name) - length(suffix)), '_input$', '') AS case_id,
       {_safe_segment('url')} AS segment,
       {_safe_label('url')} AS label,
       lower(suffix) AS suffix,
       '_source-x_' || {_safe_label('url')} AS filter_suffix
FROM u2"""

# --- dataset contract (V1-V7) ---------------------------------------------------

_DATASET = f"""
ds0 AS (SELECT {', '.join(f"{v} AS {k}" for k, v in D.DATASET_SQL.items())} FROM conversations),
ds AS (
  SELECT * FROM ds0
  WHERE NOT (coalesce(trim(id), '') = '' AND coalesce(trim(turn), '') = ''
             AND coalesce(trim(prompt), '') = '' AND coalesce(trim(expected), '') = '')
),
cells AS (
  SELECT key_conv, key_turn, 'id' AS col, id AS v, 'int' AS kind FROM ds
  UNION ALL SELECT key_conv, key_turn, 'turn', turn, 'int' FROM ds
  UNION ALL SELECT key_conv, key_turn, 'prompt', prompt, 'str' FROM ds
  UNION ALL SELECT key_conv, key_turn, 'expected', expected, 'str' FROM ds
),
bad AS (
  SELECT key_conv, key_turn, col AS "column",
         CASE WHEN v IS NULL OR trim(v) = '' THEN 'required'
              WHEN kind = 'int' AND NOT regexp_matches(v, '^\\s*[+-]?[0-9]+\\s*$') THEN 'type' END AS rule,
         v AS value
  FROM cells
)"""

SQL["validate_rows"] = f"""{_with(_DATASET)}
SELECT key_conv, key_turn, "column", rule, value FROM bad WHERE rule IS NOT NULL"""

SQL["validated_rows"] = f"""{_with(_DATASET)}
SELECT key_conv, key_turn, CAST(trim(id) AS BIGINT) AS id, CAST(trim(turn) AS BIGINT) AS turn, prompt, expected
FROM ds WHERE NOT EXISTS (
  SELECT 1 FROM bad WHERE bad.rule IS NOT NULL AND bad.key_conv = ds.key_conv AND bad.key_turn = ds.key_turn)"""

# --- reshape (N1, N2) --------------------------------------------------------------

# The last cell of a short row is an empty one; a row without any is blank.
SQL["csv_dataset"] = f"""
WITH c AS (SELECT {D.CSV_FILE_SQL} AS g, conv_id, turn, role, coalesce(text, '') AS text, conv_id % 7 = 3 AS short FROM conversations),
cells AS (
  SELECT g, conv_id AS k, turn AS t, CASE WHEN short AND g % 3 = 1 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS conv_id,
    CAST(turn AS VARCHAR) AS turn, role, CASE WHEN short AND g % 3 <> 1 THEN '' ELSE text END AS text
  FROM c WHERE NOT (conv_id % 13 = 5 AND turn = 1))
SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY k, t) AS INTEGER) AS row_index, conv_id, turn, role, text,
  CAST(NULL AS VARCHAR) AS no_such FROM cells"""

_JSON_ROWS = f"""
WITH o AS (
  SELECT {D.JSON_FILE_SQL} AS g, o_orderkey AS k, o_orderkey % 8 AS m, o_custkey AS c, o_orderstatus AS s FROM orders),
rows AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY k) AS INTEGER) AS row_index FROM o WHERE k % 97 <> 0)"""

SQL["json_dataset"] = f"""{_JSON_ROWS}
SELECT g, row_index, CASE WHEN m = 4 THEN 1 ELSE k END AS id,
  CASE m WHEN 5 THEN 1.5 WHEN 4 THEN 1.0 ELSE c + 0.25 END::DOUBLE AS price, m IN (0, 4) AS flag,
  CASE m WHEN 0 THEN '12.5' WHEN 1 THEN 'True' WHEN 4 THEN '10000000.5' ELSE CAST(c AS VARCHAR) END AS note
FROM rows WHERE g % 11 <> 7 AND g % 13 <> 4 AND m IN (0, 1, 4, 5)"""

SQL["json_dataset_violations"] = f"""{_JSON_ROWS},
sound AS (SELECT * FROM rows WHERE g % 11 <> 7 AND g % 13 <> 4)
SELECT g, row_index, 'id' AS column, 'type' AS rule, CASE m WHEN 3 THEN '12.7' ELSE '[1]' END AS value FROM sound WHERE m IN (3, 6)
UNION ALL SELECT g, row_index, 'price', 'type', 'abc' FROM sound WHERE m = 7
UNION ALL SELECT g, row_index, 'note', 'required', CASE m WHEN 3 THEN ' ' END FROM sound WHERE m IN (2, 3)
UNION ALL SELECT DISTINCT g, CAST(NULL AS INTEGER), 'flag', 'missing_column', NULL FROM o WHERE g % 13 = 4 AND g % 11 <> 7
UNION ALL SELECT DISTINCT g, CAST(NULL AS INTEGER), NULL, 'unreadable', 'JSON dataset rows must be objects.' FROM o WHERE g % 11 = 7"""

SQL["to_long"] = """WITH j AS (
  SELECT n.n_name, r.r_name,
         CASE WHEN s.s_acctbal < 0 THEN 'negative' WHEN s.s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
)
SELECT band AS unit, n_name AS item, 'count' AS num_type, r_name AS status_type, CAST(count(*) AS BIGINT) AS value
FROM j GROUP BY band, n_name, r_name"""

SQL["check_document"] = f"""WITH d0 AS (
  SELECT doc_id, {D.DOC_SQL} AS doc FROM documents
), d AS (
  SELECT doc_id, doc, json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc END) = 'OBJECT' AS ok FROM d0
), p AS (
  SELECT doc_id, ok,
         CASE WHEN ok THEN len(json_keys(doc)) END AS n_top,
         CASE WHEN ok THEN json_extract_string(doc, '$.document_info.source_type') END AS st,
         CASE WHEN ok THEN json_extract_string(doc, '$.document_info.filename') END AS fn,
         CASE WHEN ok AND json_type(doc, '$.summary') = 'OBJECT' THEN json_extract(doc, '$.summary') END AS summ,
         CASE WHEN ok AND json_type(doc, '$.content_data') = 'ARRAY' THEN json_extract(doc, '$.content_data') END AS tabs
  FROM d
), q AS (
  SELECT p.*,
         CASE WHEN tabs IS NOT NULL THEN json_array_length(tabs) END AS n_tabs,
         CASE WHEN tabs IS NOT NULL THEN json_extract_string(tabs, '$[*].table_name') END AS names,
         CASE WHEN tabs IS NOT NULL THEN json_extract(tabs, '$[*]') END AS tlist
  FROM p
), r AS (
  SELECT doc_id,
         (NOT coalesce(ok, false)) OR n_top <> 3 AS top_keys,
         NOT coalesce(st IN ('Excel', 'PDF'), false) AS source_type,
         coalesce(trim(fn), '') = '' AS filename,
         summ IS NULL OR len(list_filter(json_keys(summ), lambda k: json_type(summ, '$."' || k || '"') IN ('OBJECT', 'ARRAY'))) > 0
           AS summary_scalars,
         coalesce(n_tabs, 0) <= 0 AS content_empty,
         coalesce(len(list_distinct(names)) <> len(names) OR list_contains(names, NULL), false) AS table_names_unique,
         coalesce(len(list_filter(tlist, lambda t:
             json_type(t, '$.headers') IS DISTINCT FROM 'ARRAY'
             OR len(list_distinct(json_extract_string(t, '$.headers[*]'))) <> json_array_length(t, '$.headers')
             OR len(list_filter(json_extract_string(t, '$.headers[*]'), lambda h: h IS NULL OR trim(h) = '')) > 0)) > 0, false)
           AS headers_unique,
         coalesce(len(list_filter(tlist, lambda t:
             json_type(t, '$.rows') IS DISTINCT FROM 'ARRAY'
             OR len(list_filter(json_extract(t, '$.rows[*]'), lambda rw:
                  len(json_keys(rw)) <> len(list_distinct(json_extract_string(t, '$.headers[*]')))
                  OR len(list_filter(json_keys(rw), lambda k: NOT list_contains(json_extract_string(t, '$.headers[*]'), k))) > 0)) > 0)) > 0, false)
           AS row_keys
  FROM q
)
SELECT doc_id, rule FROM r
UNPIVOT (bad FOR rule IN (top_keys, source_type, filename, summary_scalars, content_empty,
                          table_names_unique, headers_unique, row_keys))
WHERE bad"""

# --- streaming (T-1, T-2): final states equal the batch results ---------------

SQL["stream_run_counters"] = SQL["run_summary"]
SQL["stream_run_abort"] = SQL["run_summary_abort"]
SQL["stream_report_merge"] = SQL["merge_overall"]

SQL["stream_model_merge"] = f"""{_with(RUNS_CTE, _SPLIT, _case_rows('base_runs', 'base_cases'), _case_rows('new_runs', 'new_cases'),
                                      _model_rows('base_runs', 'base_models'), _model_rows('new_runs', 'new_models'), _MERGED)}
SELECT model, round(average_score, 6) AS average_score, round(average_seconds, 6) AS average_seconds,
       total_runs, completed_runs FROM merged_models"""

# --- prompts (M14, M16) -----------------------------------------------------------

SQL["build_prompts"] = """SELECT doc_id, 'Excel' AS source_type,
  regexp_replace(
    concat(chr(10), 'Extract the tables of the source document as JSON with keys document_info, summary, content_data.',
           chr(10), chr(10), 'SOURCE FILENAME:', chr(10), source, '_', CAST(doc_id AS VARCHAR), '.txt',
           chr(10), chr(10), 'SOURCE:', chr(10), text, chr(10)),
    '^\\s+|\\s+$', '', 'g') AS prompt
FROM documents"""
