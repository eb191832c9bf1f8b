"""Plan shape: no all-pairs joins, filters and columns reach the scan; a slice of the registered queries against DuckDB."""
import duckdb
import pytest

import __spark_entry__ as entry
from checks.base import TABLES
from checks.compare import rows_of

SMALL = "/root/testdata/sf0.001"
KEYED = ["variety_place_scores", "nearest_neighbours", "pollinators", "matched_names", "lab_percentiles", "final_tags", "heading_candidates", "consolidated_listing", "resolved_reports", "rootstock_fit", "quote_verification"]


@pytest.mark.parametrize("name", KEYED)
def test_no_all_pairs_join(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_is_pruned(spark):
    from checks.base import fixture
    from graftline.operators import views as vw

    v = spark.read.parquet(f"{SMALL}/part.parquet")
    plan = v.where("p_size < 5").select("p_name")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(p_size,5)" in plan and "p_retailprice" not in plan
    _ = (fixture, vw)


def test_place_features_go_over_the_seasons_once(spark):
    """Normals are partial sums of two narrow scans; the days are shuffled whole for the seasons alone, and gaps are filled once."""
    from graftline.plans.place_features import place_features

    days = spark.range(3 * 366 * 4).selectExpr("id % 3 AS place_id", "45.0 AS lat", "date_add(date '2001-01-01', cast(id / 3 as int)) AS day", "10.0 + id % 9 AS tmax", "1.0 + id % 5 AS tmin", "0.5 AS prcp")
    import tempfile

    at = tempfile.mkdtemp(prefix="run-")
    days.write.mode("overwrite").parquet(at)
    f = place_features(spark.read.parquet(at))
    f.collect()
    plan = f._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 3 and plan.count("REPARTITION_BY_COL") == 1 and plan.count("Generate explode(slots") == 1, (plan.count("FileScan parquet"), plan.count("REPARTITION_BY_COL"), plan.count("Generate explode(slots"))


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["weather_cycles", "best_and_worst_places", "suggested_pollinators", "panel_records", "theme_batches", "tasting_summary", "patched_records", "streamed_bloom"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_pairs_are_merged(spark):
    """Varieties and places grow, so neither is sent whole to every task; words of places are never paired with all that share them."""
    import __spark_entry__ as entry

    def plan(name):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        return df._jdf.queryExecution().executedPlan().toString()

    for name in ("ripening", "variety_place_scores", "disease_losses"):
        assert "BroadcastHashJoin" not in plan(name), name
    assert "Generate" not in plan("home_place")


def test_names_of_accessions_are_read_once(spark):
    """Accessions of one name are one row until the end, and each gets its row."""
    from graftline.operators import matching

    index = spark.createDataFrame([("gala", True, 1, "exact")], "key string, strict boolean, variety_id long, kind string")
    names = ["Gala", "Gala (LA 3A)", "Gala (Kent)", "Gala (red sport)"]
    a = spark.range(40).selectExpr("id AS accession_id", "'P' AS source", f"element_at(array{tuple(names)}, CAST(id % 4 AS INT) + 1) AS name")
    out = matching.classify_accessions(a, index)
    assert "Aggregate [accession_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["accession_id"]: (r["name"], r["tier"]) for r in out.collect()}
    assert got == {i: (names[i % 4], "loose" if i % 4 == 2 else "firm") for i in range(40) if i % 4 != 3}


def test_edges_do_not_wait_for_merges(spark, monkeypatch):
    """Edges between listed names follow from the listing alone; nothing is merged for them."""
    from graftline.operators import gaps

    def merged(*_):
        raise AssertionError("merged")

    monkeypatch.setattr(gaps, "merge_candidates", merged)
    assert set(entry.queries()["merge_edges"](spark, SMALL).columns) == {"a", "b"}
