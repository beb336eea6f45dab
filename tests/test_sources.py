"""Reading, validating, ingesting and saving."""

import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.catalog import fixtures
from shelfcast.operators import clean, integrity
from shelfcast.schema import ENTITIES, UNIQUE_KEYS
from shelfcast.sources import artifacts, entities, panel
from shelfcast.streaming.ingest import ingest_arrivals

HEADER = " Store ID,Date,Product ID,Category,Region,Inventory Level,Units Sold,Price,Holiday/Promotion,Shelf"


def write_csv(folder, name, lines):
    path = folder / name
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.fixture
def upload(tmp_path):
    return write_csv(
        tmp_path,
        "upload.csv",
        [
            "S1,2024-01-01,P1,Toys,North,10,3,9.5,1,a",
            "S1,2024-01-01,P1,Toys,North,11,4,9.5,0,b",
            "S2,01/02/2024,P2,Toys,South,12.0,5,NaN,0,c",
            "S2,not a day,P2,Toys,South,x,6,1.5,0,d",
        ],
    )


def test_csv_is_typed_by_header_name(spark, upload):
    df = panel.read_panel(spark, upload)
    kinds = {field.name: field.dataType for field in df.schema.fields}
    assert kinds["date"] == T.DateType() and kinds["price"] == T.DoubleType()
    assert kinds["inventory_level"] == T.IntegerType() and kinds["shelf"] == T.StringType()
    rows = {r.shelf: r for r in df.collect()}
    assert rows["a"].date == datetime.date(2024, 1, 1) and rows["a"].holiday_promotion == 1
    assert rows["c"].date == datetime.date(2024, 1, 2) and rows["c"].inventory_level == 12
    assert rows["c"].price is None
    assert rows["d"].date is None and rows["d"].inventory_level is None


def test_strict_dates_fail_on_bad_text(spark, upload):
    with pytest.raises(Exception, match="not a date"):
        panel.read_panel(spark, upload, strict_dates=True).collect()


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("S", "P")], "store_id string, product_id string")
    with pytest.raises(panel.MissingColumns, match="date, category, region") as caught:
        panel.validate_columns(df)
    assert caught.value.columns[-1] == "price"


def test_later_row_of_an_upload_wins(spark, upload):
    batch = panel.read_panel(spark, upload, keep_file_order=True).filter("store_id = 'S1'")
    merged = panel.upsert_keep_last(batch.limit(0).drop(panel.ROW_ORDER), batch)
    assert [r.shelf for r in merged.collect()] == ["b"]
    assert panel.ROW_ORDER not in merged.columns


def test_upsert_twice_changes_nothing(spark):
    old, new = fixtures.batch_old(spark, SMALL), fixtures.batch_new(spark, SMALL)
    once = panel.upsert_keep_last(old, new)
    twice = panel.upsert_keep_last(once, new)
    assert once.exceptAll(twice.select(*once.columns)).count() == 0
    assert integrity.check_unique(twice, panel.PANEL_KEY).count() == 0


def test_ingesting_a_batch_again_replaces_it(spark, upload, tmp_path):
    target = str(tmp_path / "landing")
    batch = panel.read_panel(spark, upload)
    panel.ingest_batch(batch, target, "one")
    panel.ingest_batch(batch, target, "two")
    panel.ingest_batch(batch.filter("shelf = 'a'"), target, "two")
    counts = {r.ingest_id: r["count"] for r in spark.read.parquet(target).groupBy("ingest_id").count().collect()}
    assert counts == {"one": 4, "two": 1}
    assert "uploaded_at" in spark.read.parquet(target).columns


def test_ingest_refuses_a_batch_without_required_columns(spark, tmp_path):
    df = spark.createDataFrame([("S",)], ["Store ID"])
    with pytest.raises(panel.MissingColumns):
        panel.ingest_batch(df, str(tmp_path / "landing"), "bad")


def test_written_panel_reads_back(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = fixtures.retail_panel(spark, SMALL)
    panel.write_panel(rows, path)
    back = panel.read_panel(spark, path, fmt="parquet").drop("year")
    assert back.select(*rows.columns).exceptAll(rows).count() == 0
    assert back.count() == rows.count()


def test_clean_panel_drops_bad_rows(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a"), (-1, 2.0, "a"), (1, 0.0, "a"), (1, 2.0, None), (1, float("nan"), "a")],
        "units_sold int, price double, note string",
    )
    assert clean.clean_panel(df).count() == 1


def test_min_rows_gate(spark):
    df = spark.createDataFrame([("A",)] * 3 + [("B",)] * 2, "store_id string")
    assert {r.store_id for r in clean.min_rows_gate(df, 3).collect()} == {"A"}


def test_reorder_and_evaluation_files(spark, tmp_path):
    row = spark.createDataFrame(
        [("S", "P", 1, 2.0, 3.0, 2.0, 1, 9)],
        "store_id string, product_id string, inventory_level int, predicted_weekly_demand double, "
        "reorder_point double, order_quantity double, stockout_risk int, other int",
    )
    path = str(tmp_path / "reorders")
    panel.write_reorders(row, path)
    assert spark.read.option("header", True).csv(path).columns == list(panel.REORDER_COLUMNS)


def test_entities_round_trip(spark, tmp_path):
    path = str(tmp_path / "inventory")
    rows = fixtures.inventory(spark, SMALL).withColumn("id", F.col("id").cast("int"))
    entities.write_entity(rows, "inventory", path)
    back = entities.read_entity(spark, "inventory", path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in ENTITIES["inventory"]]
    assert back.count() == rows.count()
    assert back.filter("updated_at is null").count() == 0
    for keys in UNIQUE_KEYS["inventory"]:
        assert integrity.check_unique(back, keys).count() == 0


def test_registry_keeps_the_latest_and_lists_global_last(spark, tmp_path):
    path = str(tmp_path / "registry")
    kinds = (
        "store_id string, model_path string, encoder_path string, accuracy double, "
        "record_count long, size_mb double"
    )
    for version in ("v1", "v2"):
        rows = [(s, f"{version}/{s}", "e", 80.0, 10, 0.5) for s in ("GLOBAL", "S2", "S1")]
        artifacts.register_models(spark.createDataFrame(rows, kinds), path)
    listed = artifacts.model_registry(artifacts.read_registry(spark, path)).collect()
    assert [r.store_id for r in listed] == ["S1", "S2", "GLOBAL"]
    assert all(r.model_path.startswith("v2/") for r in listed)


def test_a_compacted_registry_has_the_same_latest_models(spark, tmp_path):
    path = str(tmp_path / "registry")
    kinds = "store_id string, model_path string, encoder_path string, accuracy double, record_count long, size_mb double"
    for run, stores in (("r1", ("S1", "S2")), ("r2", ("S2",)), ("r3", ("S2", "S3"))):
        for kind in ("m", "e"):
            (tmp_path / f"{kind}-{run}").mkdir()
        rows = [(s, f"file://{tmp_path}/m-{run}", f"file://{tmp_path}/e-{run}", 80.0, 10, 0.5) for s in stores]
        artifacts.register_models(spark.createDataFrame(rows, kinds), path)
    before = artifacts.model_registry(artifacts.read_registry(spark, path)).collect()
    unused = {r.folder.rsplit("/")[-1] for r in artifacts.unused_folders(artifacts.read_registry(spark, path)).collect()}
    assert unused == {"m-r2", "e-r2"}
    assert artifacts.expire_runs(spark, path, "2000-01-01") == 0 and (tmp_path / "m-r2").exists()
    assert artifacts.expire_runs(spark, path) == 2
    assert not (tmp_path / "m-r2").exists() and (tmp_path / "e-r1").exists()
    log = artifacts.read_registry(spark, path)
    assert log.count() == 3 and artifacts.model_registry(log).collect() == before
    assert artifacts.compact_registry(spark, path) == 1 and artifacts.compact_registry(spark, path) == 1
    artifacts.register_models(spark.createDataFrame([("S1", "m-r4", "e-r4", 81.0, 10, 0.5)], kinds), path)
    latest = {r.store_id: r.model_path for r in artifacts.model_registry(artifacts.read_registry(spark, path)).collect()}
    assert latest["S1"] == "m-r4" and len(latest) == 3


def test_arrivals_are_ingested_once(spark, tmp_path):
    source, landing = tmp_path / "in", str(tmp_path / "landing")
    rows = fixtures.retail_panel(spark, SMALL).limit(50).cache()
    rows.write.parquet(str(source))

    def run():
        ingest_arrivals(spark, str(source), rows.schema, landing, str(tmp_path / "state")).awaitTermination()

    run()
    run()
    assert spark.read.parquet(landing).count() == 50
    rows.write.mode("append").parquet(str(source))
    run()
    landed = spark.read.parquet(landing)
    assert landed.count() == 100
    kept = panel.keep_last(landed, [F.col("ingest_id")])
    assert kept.count() == 50


def test_landed_rows_keep_types_and_order(spark, tmp_path):
    header = "date,store_id,product_id,category,region,inventory_level,units_sold,price,discount,weather_condition,holiday_promotion,competitor_pricing,seasonality"
    source, target = tmp_path / "batch.csv", str(tmp_path / "landing")
    lines = [f"2024-01-02,S1,P1,c,r,5,{n},1.5,0,w,0,1.0,s" for n in (9, 3)]
    source.write_text("\n".join([header, *lines]) + "\n")
    batch = panel.read_panel(spark, str(source), keep_file_order=True)
    panel.ingest_batch(batch.withColumn("units_sold", F.col("units_sold").cast("string")), target, "one")
    landed = spark.read.parquet(target)
    assert dict(landed.dtypes)["units_sold"] == "int"
    for upsert in (panel.upsert_keep_last, panel.upsert_unique):
        assert [r.units_sold for r in upsert(landed.limit(0), landed).collect()] == [3]
