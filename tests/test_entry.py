"""The driver's contract: every query's name, and oracle rows of a few of them at the smallest size."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FEW = ["garment_status_report", "rule_hit_counts", "suppressed_boxes", "detection_metrics", "error_buckets", "match_scores", "spend", "weather_as_of", "merged_items", "retry_resolution", "latency_stats"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_absent_modules_are_left_out_and_broken_ones_are_not(monkeypatch):
    real = entry.importlib.import_module

    def load(name):
        if name in entry.OPTIONAL:
            raise ModuleNotFoundError(name=missing)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", load)
    missing = "weft.llm"
    assert "best_outfits" in entry.queries() and not any(n.startswith("op1") for n in entry.queries())
    missing = "weft.llm.worms"
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FEW)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "customer", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda df: sorted(tuple("null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df[cols].itertuples(index=False))
    assert text(got) == text(want)
