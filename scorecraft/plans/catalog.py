"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole driver tables (see ``scorecraft.plans.derived``).

Doubles are rounded to 6 places at the output only (T5); counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from scorecraft.functions import jsonops as J
from scorecraft.functions import keys as K
from scorecraft.operators import accuracy as A
from scorecraft.operators.layout import written
from scorecraft.plans import derived as D
from scorecraft.sources import reports as RP
from scorecraft.sources import sinks as SK

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn

    return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (output presentation only)."""
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _scored_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = D.evaluations(spark, sf_dir)
    return A.score_rows(ev, category="from_truth")


@register("strict_accuracy")
def q_strict_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 per evaluation row."""
    scored = _scored_evaluations(spark, sf_dir)
    return rounded(scored.select("eval_id", "model", "source", "strict_score", "parse_error"))


@register("partial_exact")
def q_partial_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M5 per evaluation row."""
    scored = _scored_evaluations(spark, sf_dir)
    return rounded(scored.select("eval_id", "exact", F.col("partial").alias("partial_score"), "parse_error"))


@register("category_accuracy")
def q_category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + A12 + A13: overall and per category."""
    scored = _scored_evaluations(spark, sf_dir)
    return rounded(A.accuracy_scopes(None, scopes=("category",), scored=scored))


@register("accuracy_scopes")
def q_accuracy_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10-A13 with A11 by model and by source (grouping sets)."""
    scored = _scored_evaluations(spark, sf_dir)
    return rounded(A.accuracy_scopes(None, scored=scored))


@register("category_label")
def q_category_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 (with M8) per evaluation row."""
    ev = D.evaluations(spark, sf_dir)
    parsed = J.with_canonical_object(ev, "ground_truth", "_truth", keep_object="_truth_obj")
    labelled = K.with_category(parsed, "_truth_obj", "_category")
    return labelled.select("eval_id", K.normalize_category("_category").alias("category"))


# --- runs: evaluate recorded outputs, summarise (U1, A1-A3) -----------------

from scorecraft.operators import cases as CS  # noqa: E402
from scorecraft.operators import compare as C  # noqa: E402
from scorecraft.operators import generate as G  # noqa: E402
from scorecraft.operators import scoring as S  # noqa: E402


def _outputs(spark: SparkSession, sf_dir: str, with_auth: bool = True) -> DataFrame:
    ev = D.evaluations(spark, sf_dir)
    kind = F.col("error_kind") if with_auth else F.when(F.col("error_kind").isNotNull(), F.lit("error"))
    return ev.select(
        "model", "case_id", "source", "row_index", "ground_truth",
        F.col("llm_output").alias("output"), kind.alias("error_kind"), "error_message",
    )


@register("run_summary")
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + A1: report rows per (model, case), failed rows included."""
    reports = S.evaluate(None, _outputs(spark, sf_dir, with_auth=False))
    return rounded(S.run_summary(reports))


def _dataset_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, outputs): the dataset of a case holds the orders of its
    priority; a model (order status) has recorded outputs for its own orders
    only, so each run meets rows without an output."""
    ev = D.evaluations(spark, sf_dir)
    dataset = ev.select("case_id", "row_index", "ground_truth")
    outputs = ev.select("model", "case_id", "row_index", F.col("llm_output").alias("output"), "error_kind", "error_message")
    return dataset, outputs


@register("evaluate_dataset")
def q_evaluate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 driven by the dataset + A1: every run over all rows of its case."""
    dataset, outputs = _dataset_run(spark, sf_dir)
    recorded = outputs.withColumn("error_kind", F.when(F.col("error_kind").isNotNull(), F.lit("error")))
    return rounded(S.run_summary(S.evaluate(dataset, recorded)))


@register("generated_reports")
def q_generated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 with a generator: two models answer every conversation turn (some
    refuse, some are limited, some fail), then the report rows up to the abort."""
    dataset = D.prompt_dataset(spark, sf_dir)
    runs = CS.run_matrix(D.GENERATOR_MODELS, dataset.select("case_id").distinct(), order_col="case_id")
    outputs = G.generate(dataset, runs, D.RuleGenerator(), retry_delay_seconds=0.0)
    attempts = outputs.select("model", "case_id", "row_index", "attempts")
    reports = S.evaluate(dataset, outputs)
    return rounded(reports.join(attempts, ["model", "case_id", "row_index"]))


@register("failed_preprocess")
def q_failed_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the runs of every broken dataset (here: an odd number of rows) fail."""
    dataset, outputs = _dataset_run(spark, sf_dir)
    recorded = outputs.withColumn("error_kind", F.when(F.col("error_kind").isNotNull(), F.lit("error")))
    broken = dataset.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1)
    failures = broken.select("case_id", F.concat(F.lit("cannot read "), F.col("case_id")).alias("error_message"))
    return rounded(S.with_failed_runs(S.run_summary(S.evaluate(dataset, recorded)), failures))


@register("run_summary_abort")
def q_run_summary_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + A1 + A2: runs stop at their first authentication failure."""
    return rounded(S.run_summary_with_abort(_outputs(spark, sf_dir), None))


@register("row_truths")
def q_row_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the expected output where it is an object, else the other columns."""
    ev = D.evaluations(spark, sf_dir)
    others = {"case_id": F.col("case_id"), "row_index": F.col("row_index"), "error_kind": F.col("error_kind")}
    return ev.select("eval_id", J.ground_truth_object(F.col("llm_output"), others).alias("truth"))


@register("success_fractions")
def q_success_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + M18: completed and all rows of each run as one text."""
    summary = S.run_summary(S.evaluate(None, _outputs(spark, sf_dir, with_auth=False)))
    return summary.select("model", "case_id", K.success_fraction("successful_evaluations", "total_rows").alias("fraction"))


@register("report_rows")
def q_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report rows (D6) up to each run's abort point."""
    reports = S.evaluate(None, _outputs(spark, sf_dir))
    return rounded(reports)


# --- compare runs (A4-A8, J5, J6) -------------------------------------------


@register("case_comparison")
def q_case_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + R1: best and fastest model per case with input-order ties."""
    return rounded(C.case_comparison(D.runs(spark, sf_dir)))


@register("model_summary")
def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: per-model means and run counts."""
    return rounded(C.model_summary(D.runs(spark, sf_dir)).drop("first_run"))


@register("overall_winners")
def q_overall_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and fastest model over the model summary."""
    return rounded(C.overall_winners(C.model_summary(D.runs(spark, sf_dir))))


@register("overall_report")
def q_overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + R6: the whole overall report."""
    return rounded(C.overall_report(D.runs(spark, sf_dir)))


@register("merge_overall")
def q_merge_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + J5 + J6: the report of the first half merged with the second."""
    base_runs, new_runs = D.split_runs(spark, sf_dir)
    return rounded(C.merge_overall(C.overall_report(base_runs), new_runs))


@register("merge_cases")
def q_merge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case rows of the merged report."""
    base_runs, new_runs = D.split_runs(spark, sf_dir)
    base = C.overall_report(base_runs)
    base_cases = C.section(base, C.CASE_SECTION).select(
        "case_id", "best_model", "best_score", "fastest_model", "fastest_seconds", "total_runs", "completed_runs"
    )
    return rounded(C.merge_case_rows(base_cases, C.case_comparison(new_runs)))


# --- per-source score columns (A9, J7, J8) -----------------------------------

from scorecraft.operators import recommend as R  # noqa: E402
from scorecraft.operators import source_scores as SS  # noqa: E402

# The sources of the derived evaluations (o_orderpriority).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FOCUS_SOURCE = "1-URGENT"


def _eval_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows (D6) with their source, from the recorded outputs."""
    return S.evaluate(None, _outputs(spark, sf_dir), run_keys=("model", "case_id", "source"))


def _eval_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run summary (A1 + A2) of the recorded outputs with the runs' F1
    sums carried along: each output is scored once, and both the model
    summary and the per-source columns are built from these run rows."""
    outputs = _outputs(spark, sf_dir)
    keys = ("model", "case_id", "source")
    aborts = S.first_auth_failure(outputs, keys)
    reports = S.evaluate(None, outputs, keys, aborts=aborts)
    totals = S.run_totals(reports, keys, extra_aggs=SS.f1_run_aggs())
    return S.summary_from_totals(aborts, totals, keys, keep=("_f1_sum", "_f1_n"))


def _models_with_sources(spark: SparkSession, sf_dir: str, sources: list[str]) -> DataFrame:
    """A5 over the batch results (D8) of the evaluation runs - seconds stand
    in as the number of rows attempted - with the A9 source columns, all in
    one aggregate of the run rows."""
    per_run = _eval_run_totals(spark, sf_dir)
    runs = per_run.select(
        "model", "case_id", "source", "status", "average_score", "_f1_sum", "_f1_n",
        F.col("total_rows").cast("double").alias("elapsed_seconds"),
        F.col("total_rows").alias("run_index"),
    )
    return runs.groupBy("model").agg(*C.model_summary_aggs(), *SS.source_mean_aggs(sources))


@register("source_scores")
def q_source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + F1 + F3 + F6: mean score per model over one source."""
    return rounded(SS.source_scores(_eval_reports(spark, sf_dir), FOCUS_SOURCE))


@register("source_column")
def q_source_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model summary with one score column per source."""
    return rounded(_models_with_sources(spark, sf_dir, PRIORITIES).drop("first_run"))


@register("source_winners")
def q_source_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner rows with the focus source's score; fastest row blank."""
    models = _models_with_sources(spark, sf_dir, [FOCUS_SOURCE])
    winners = C.winner_rows(models).select(
        "section", "model", "average_score", "average_seconds", "total_runs", "completed_runs", FOCUS_SOURCE
    )
    return rounded(SS.blank_fastest_row(winners, FOCUS_SOURCE))


@register("source_report")
def q_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + R5 + J7 + J8: an overall report is written (K2) and read again, and
    its model rows and, if both are there, its winners get the source columns."""
    outputs = _outputs(spark, sf_dir)
    keys = ("model", "case_id", "source")
    reports = written(S.evaluate(None, outputs, keys), "reports")
    aborts = S.first_auth_failure(outputs, keys)
    runs = S.summary_from_totals(aborts, S.run_totals(reports, keys), keys).select(
        "model", "case_id", "status", "average_score",
        F.col("total_rows").cast("double").alias("elapsed_seconds"), F.col("total_rows").alias("run_index"),
    )
    path = D.scratch(spark, "overall")
    report = RP.read_overall_report(spark, SK.write_overall_report(C.overall_report(runs), path))
    columns = ["section", "model", "average_score", "average_seconds", "total_runs", "completed_runs"]
    models = SS.add_source_scores(C.section(report, C.MODEL_SECTION).select(*columns), reports, PRIORITIES)
    winners = C.winners_if_complete(report).select(*columns)
    for source in PRIORITIES:
        winners = SS.add_source_score_to_winners(winners, reports, source)
    return rounded(models.unionByName(winners))


# --- the report over stored artifacts (E3: K1, K4, S4, F2, F4, J4, A10-A13) ---------


@register("stored_accuracy")
def q_stored_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category report of one source and model from artifacts: report rows
    in the partitioned store, truths in runtime datasets, a file a run."""
    outputs = D.stored_outputs(spark, sf_dir)
    store, runtime = D.scratch(spark, "report-store"), D.scratch(spark, "runtime")
    SK.write_run_reports(S.evaluate(None, outputs, ("model", "source", "case_id")), store)
    prompts = outputs.select(
        "model", "source", "case_id", "row_index", F.lit("extract").alias("prompt"), F.col("ground_truth").alias("expected_output")
    )
    SK.write_eval_dataset(prompts, runtime, keys=("model", "source", "case_id"))
    source, model = " 1-URGENT ", "F"
    return rounded(A.stored_accuracy(spark, store, RP.read_ground_truths(spark, runtime, source, model), source, model))


# --- recommendations (R2, X1, X2, X4) ----------------------------------------


def _category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored_evaluations(spark, sf_dir)
    return R.category_scores(A.accuracy_scopes(None, scopes=("category",), scored=scored))


@register("recommendations")
def q_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + X2 + X4 + M17: categories below 0.70, ranked, with their gap."""
    return rounded(R.rank_low_categories(_category_scores(spark, sf_dir)))


@register("recommendation_state")
def q_recommendation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recommendation block applies."""
    return R.recommendation_state(_category_scores(spark, sf_dir))


# --- cases: pairing, run matrix, expected outputs (S7, J1-J3, F5, A14) --------


@register("pair_cases")
def q_pair_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + J2 + M11: input files paired with their expected-output CSV."""
    cases, _ = CS.pair_cases(D.part_listing(spark, sf_dir))
    return cases


@register("skipped_cases")
def q_skipped_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + F5: unsupported inputs and inputs without an output, with reasons."""
    _, skipped = CS.pair_cases(D.part_listing(spark, sf_dir))
    return skipped


@register("run_matrix")
def q_run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model (distinct event types, name order) x every supplier case."""
    models = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"))
    suppliers = D.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("suppliers.v1/"), F.col("s_name"), F.lit("_input.pdf")).alias("input_path")
    )
    cases = suppliers.select(K.case_id("input_path").alias("case_id"), "input_path")
    matrix = CS.run_matrix(models, cases)
    return matrix.select("model", "case_id", "run_index")


@register("expected_output")
def q_expected_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected-output document of every order from its line items."""
    return CS.expected_output(D.truth_rows(spark, sf_dir), D.order_cases(spark, sf_dir))


# --- names and labels (M10-M14) -----------------------------------------------


@register("safe_names")
def q_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, M12, M13, M14 on part names and types."""
    part = D.table(spark, sf_dir, "part")
    report_name = F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), " ", "__")
    model, source = K.report_key_parts(report_name)
    return part.select(
        "p_partkey",
        K.safe_segment(F.concat_ws("/", "p_brand", "p_name")).alias("segment"),
        K.safe_label(F.concat_ws(" ", "p_brand", "p_name")).alias("label"),
        model.alias("model"),
        source.alias("source"),
        K.source_type(F.when(F.col("p_size") % 3 == 0, F.lit(".PNG")).otherwise(F.lit("xlsx"))).alias("source_type"),
    )


@register("url_labels")
def q_url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11, M12, M13 and the T8 suffix rule on page URLs."""
    pages = D.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(
        "page_id",
        K.case_id("url").alias("case_id"),
        K.safe_segment("url").alias("segment"),
        K.safe_label("url").alias("label"),
        F.lower(K.path_suffix("url")).alias("suffix"),
        K.filter_suffix(F.lit(" source-x "), F.col("url")).alias("filter_suffix"),
    )


# --- dataset contract (V1-V7) -------------------------------------------------

from scorecraft.operators import validate as V  # noqa: E402


@register("validate_rows")
def q_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V5: one violation per failing cell (quarantine split)."""
    _, violations = V.validate(D.text_dataset(spark, sf_dir), D.DATASET_SCHEMA, ["key_conv", "key_turn"])
    return violations


@register("validated_rows")
def q_validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 + V5 + V7: the valid rows, typed, schema columns in schema order."""
    valid, _ = V.validate(D.text_dataset(spark, sf_dir), D.DATASET_SCHEMA, ["key_conv", "key_turn"])
    return valid


# --- dataset files (S2, S3, R3, V1-V7) ---------------------------------------------

from scorecraft.sources import datasets as DS  # noqa: E402


@register("csv_dataset")
def q_csv_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + R3: CSV files with headers of their own, read together."""
    path = D.conversation_csv_files(spark, sf_dir)
    rows = DS.read_dataset_csv(spark, f"{path}/*", ["conv_id", "turn", "role", "text", "no_such"])
    return rows.select(D.file_number().alias("g"), "row_index", "conv_id", "turn", "role", "text", "no_such")


def _json_dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = D.order_json_files(spark, sf_dir)
    rows, headers = DS.read_dataset_json_files(spark, path, list(D.JSON_SCHEMA), typed=True)
    return V.validate_files(rows, headers, D.JSON_SCHEMA)


@register("json_dataset")
def q_json_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + V2 + V4: the valid rows of JSON datasets, cast by JSON type."""
    valid, _ = _json_dataset(spark, sf_dir)
    return rounded(valid.select(D.file_number().alias("g"), "row_index", *D.JSON_SCHEMA))


@register("json_dataset_violations")
def q_json_dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + V2-V4: what is wrong in the JSON datasets, by file, row and column."""
    _, violations = _json_dataset(spark, sf_dir)
    return violations.select(D.file_number().alias("g"), "row_index", "column", "rule", "value")


# --- archives (S8-S11, U3) ---------------------------------------------------------

from scorecraft.sources import documents as DOC  # noqa: E402


@register("extracted_archives")
def q_extracted_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9-S11 + U3: Word files, workbooks, a format of the caller's own and one
    that nothing reads, each by the extractor of its extension."""
    path = D.archive_files(spark, sf_dir)
    extractors = {**DOC.EXTRACTORS, ".rec": DOC.from_function(D.upper_record)}
    found = DOC.extract_documents(spark, path, extractors)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "text", "error")


# --- reshape (N1, N2) ------------------------------------------------------------

from scorecraft.operators import reshape as RS  # noqa: E402


@register("to_long")
def q_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier counts per nation and band, unpivoted, zeros dropped."""
    wide = D.supplier_bands(spark, sf_dir)
    return RS.to_long(wide, ["negative", "low", "high", "unused"], "n_name", F.lit("count"), "r_name")


@register("check_document")
def q_check_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract violations of one expected-output document per row."""
    return RS.document_violations(D.document_jsons(spark, sf_dir))


# --- streaming (T-1, T-2) -------------------------------------------------------

from scorecraft.streaming import evaluation_log as T  # noqa: E402


def _streamed_runs(spark: SparkSession, sf_dir: str, kind) -> DataFrame:
    """The runs' summaries from the log of the orders, streamed as outputs."""
    outputs = D.evaluations_of(D.stream_table(spark, sf_dir, "orders")).select(
        "model", "case_id", "row_index", "ground_truth", F.col("llm_output").alias("output"), kind.alias("error_kind"), "error_message"
    )
    # a table of few, unsplittable files: spread each micro-batch over the cores
    _, counters_path = T.run_evaluation_log(outputs, spread_to=spark.sparkContext.defaultParallelism)
    return rounded(T.run_summaries(spark, counters_path))


@register("stream_run_counters")
def q_stream_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1: orders streamed as recorded outputs, scored on arrival, running
    per-run counters in the state store; result = A1 over the whole stream."""
    return _streamed_runs(spark, sf_dir, F.when(F.col("error_kind").isNotNull(), F.lit("error")))


@register("stream_run_abort")
def q_stream_run_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1 + A2: the same with authentication failures, which end their runs."""
    return _streamed_runs(spark, sf_dir, F.col("error_kind"))


@register("stream_model_merge")
def q_stream_model_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2: the second half of the runs streamed into the model summary of
    the first half (sums in the state store, merged with the base when read)."""
    mid = D.split_point(spark, sf_dir)
    base_runs, _ = D.split_runs(spark, sf_dir)
    base = C.model_summary(base_runs)
    stream = D.runs_of(D.stream_table(spark, sf_dir, "events")).filter(F.col("run_index") >= F.lit(mid))
    state = T.merge_stream_into_summary(stream, base)
    return rounded(T.latest_state(spark, state))


@register("stream_report_merge")
def q_stream_report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2 + A8: the second half of the runs streamed into the overall report of
    the first half, with case rows and winners."""
    mid = D.split_point(spark, sf_dir)
    base_runs, _ = D.split_runs(spark, sf_dir)
    stream = D.runs_of(D.stream_table(spark, sf_dir, "events")).filter(F.col("run_index") >= F.lit(mid))
    state = T.merge_stream_into_report(stream, C.overall_report(base_runs))
    return rounded(T.latest_report(spark, state))


# --- prompts from source texts (M14, M16) ----------------------------------------

# Fixed value: the instruction placed before every source text.
INSTRUCTION = "Extract the tables of the source document as JSON with keys document_info, summary, content_data."


@register("build_prompts")
def q_build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16 + M14: one prompt per document over its whole text."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    file_name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        "doc_id",
        K.source_type(K.path_suffix(file_name)).alias("source_type"),
        K.build_prompt(INSTRUCTION, file_name, F.col("text")).alias("prompt"),
    )
