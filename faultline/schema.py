"""Canonical table schemas and key columns."""

from pyspark.sql import types as T

K = ["subset", "file_id"]

STEP = T.StructType([
    T.StructField("step_idx", T.IntegerType()),
    T.StructField("agent", T.StringType()),
    T.StructField("role_raw", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("type_norm", T.StringType()),
    T.StructField("type_source", T.StringType()),
])

TRAJECTORY = T.StructType([
    T.StructField("subset", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("mistake_agent", T.StringType()),
    T.StructField("mistake_step", T.IntegerType()),
    T.StructField("mistake_reason", T.StringType()),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("level", T.StringType()),
    T.StructField("level_scale", T.StringType()),
    T.StructField("source_file", T.StringType()),
])

STEP_SCORE = T.StructType([
    T.StructField("subset", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("step_idx", T.IntegerType()),
    T.StructField("agent", T.StringType()),
    T.StructField("type_norm", T.StringType()),
    T.StructField("type_source", T.StringType()),
    T.StructField("p_raw", T.DoubleType()),
    T.StructField("p_norm", T.DoubleType()),
    T.StructField("augmented", T.BooleanType()),
    T.StructField("judge", T.StringType()),
    T.StructField("readout", T.StringType()),
    T.StructField("policy", T.StringType()),
    T.StructField("with_gt", T.BooleanType()),
    T.StructField("use_types", T.BooleanType()),
    T.StructField("subtask_pointer", T.BooleanType()),
    T.StructField("peer_corroboration", T.BooleanType()),
    T.StructField("prefix_window", T.IntegerType()),
    T.StructField("lookahead", T.StringType()),
    T.StructField("n_lookahead", T.IntegerType()),
    T.StructField("n_demoted", T.IntegerType()),
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("prefix_tokens", T.IntegerType()),
    T.StructField("readout_tokens", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("raw_text", T.StringType()),
])

GRID_ROW = T.StructType([
    T.StructField("judge", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("with_gt", T.BooleanType()),
    T.StructField("subset", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("pred_agent", T.StringType()),
    T.StructField("pred_step", T.IntegerType()),
    T.StructField("n_calls", T.IntegerType()),
    T.StructField("raw", T.StringType()),
    T.StructField("gold_step", T.IntegerType()),
    T.StructField("gold_agent", T.StringType()),
    T.StructField("n_steps", T.IntegerType()),
])
