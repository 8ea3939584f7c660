"""Corpus scan and training contract."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cyclelake.operators.validation import check_feature_contract
from cyclelake.schema import RAW_FEATURES
from cyclelake.sources.files import read_cycle_corpus


def test_cycle_corpus(spark):
    folder = tempfile.mkdtemp(prefix="cyclelake-test-")
    with pytest.raises(FileNotFoundError):
        read_cycle_corpus(spark, folder)
    for ref in ("152", "0606"):
        Path(folder, f"machine_cycles_{ref}.csv").write_text(f"timestamp,machine_erp_ref\n2026-01-01,{ref}\n")
    Path(folder, "ground_truth.csv").write_text("a\n1\n")
    assert sorted(r["machine_erp_ref"] for r in read_cycle_corpus(spark, folder).collect()) == ["0606", "152"]


def test_feature_contract(spark):
    rows = spark.createDataFrame(
        [("2026-01-01", "1"), (None, "0"), ("2026-01-01", None)], "timestamp string, scrap_flag string"
    ).withColumns({**{f: F.lit(1.0) for f in RAW_FEATURES}, "machine_erp_ref": F.lit("152")})
    assert [r["scrap_flag"] for r in check_feature_contract(rows, "scrap_flag").collect()] == [1]
    with pytest.raises(ValueError):
        check_feature_contract(rows.drop("energy_kwh"), "scrap_flag")
    with pytest.raises(Exception, match="0/1"):
        check_feature_contract(rows.withColumn("scrap_flag", F.lit("2")), "scrap_flag").collect()
