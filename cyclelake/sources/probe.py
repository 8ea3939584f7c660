"""Qualification report: what of each file would be recognised, before anything is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.operators.validation import invalid_values
from cyclelake.schema import NUMERIC_FIELDS
from cyclelake.sources import mapping, profiling
from cyclelake.sources.files import read_table

REQUIRED = ["time"]


def probe_files(files: DataFrame, dictionary: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One report row per file of (path, length, content).

    Score: mapping confidence times 1 minus half the invalid values per row (at most 0.5).
    """
    profiles = profiling.guard_files(
        profiling.with_classification(
            profiling.with_fingerprint(profiling.with_metadata(profiling.profile_files(files)))
        )
    )
    headers = mapping.file_headers(profiles.withColumn("brand", F.col("brand_hint")))
    mapped = mapping.apply_unit_row(mapping.column_map(headers, dictionary))
    columns = mapped.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("canonical").isNotNull(), F.col("canonical")))).alias("recognised"),
        F.sort_array(F.collect_list(F.when(F.col("canonical").isNull(), F.col("label")))).alias("unknown"),
        F.count_if(~F.col("unit_compatible")).alias("unit_issues"),
        F.round(F.avg("confidence"), 3).alias("mapping_confidence"),
    )
    rows = mapping.map_rows(read_table(profiles), mapped)
    fields = sorted({*NUMERIC_FIELDS, "started_at", "ended_at"})
    text = rows.select(
        "path", "line_no", F.col("time").cast("string").alias("time"),
        *[F.try_element_at(F.col("canonical"), F.lit(f)).alias(f) for f in fields],
    )
    bad = invalid_values(text, REQUIRED, ["path", "line_no"]).groupBy("path").agg(
        F.count("*").alias("invalid_count"), F.count_distinct("line_no").alias("rows_with_invalid_values")
    )
    counted = rows.groupBy("path").agg(F.count("*").alias("rows"), F.count("time").alias("_timed"))
    report = profiles.join(columns, "path", "left").join(counted, "path", "left").join(bad, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    ratio = zero("invalid_count") / F.greatest(F.lit(1), zero("rows"))
    score = F.coalesce("mapping_confidence", F.lit(0.0)) * (1 - F.least(F.lit(0.5), ratio / 2))
    made = report.select(
        "path",
        "encoding",
        "delimiter",
        "is_transposed",
        "header_row",
        "unit_row",
        "data_start",
        F.col("brand_hint").alias("brand"),
        "fingerprint",
        "structure_label",
        "structure_score",
        "guard_code",
        "recognised",
        "unknown",
        zero("unit_issues").alias("unit_issues"),
        zero("rows").alias("rows"),
        zero("invalid_count").alias("invalid_count"),
        zero("rows_with_invalid_values").alias("rows_with_invalid_values"),
        F.when(zero("_timed") == 0, F.array(F.lit("time"))).otherwise(F.array().cast("array<string>")).alias(
            "missing_required"
        ),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("confidence"),
        ((zero("invalid_count") == 0) & (zero("unit_issues") == 0) & (zero("rows") > 0) & ~F.col("is_binary")).alias("valid"),
    )
    return made if registry is None else profiling.match_profiles(made, registry)
