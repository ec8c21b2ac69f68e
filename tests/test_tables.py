import threading
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from test_plans import plan

from tillscope.session import folder_exists, fresh_path
from tillscope.sources import tables


def dropped(spark, name):
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for version in tables.versions(spark, name).values():
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def test_a_refresh_that_fails_leaves_the_old_rows(spark):
    name = "refresh_that_fails"
    dropped(spark, name)
    tables.replace_table(spark.range(3), name)
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        tables.replace_table(broken, name)
    assert spark.table(name).count() == 3
    assert tables.replace_table(spark.range(7), name).count() == 7
    assert tables.replace_table(spark.range(2).withColumn("x", F.lit(1)), name).columns == ["id", "x"]
    dropped(spark, name)


def test_readers_during_refreshes_that_change_the_schema(spark):
    """A reader finds one whole version at any time, and never no table."""
    name = "read_while_refreshed"
    dropped(spark, name)
    tables.replace_table(spark.range(10), name)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                df = spark.table(name)
                seen.append((len(df.columns), df.count()))
            except Exception as e:  # noqa: BLE001
                seen.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 6):
        more = [F.lit(j).alias(f"c{j}") for j in range(i)]
        tables.replace_table(spark.range(10 + i).select("id", *more), name)
    stop.set()
    reader.join()
    assert len(seen) > 3 and all(s in {(1 + i, 10 + i) for i in range(6)} for s in seen)
    assert list(tables.versions(spark, name)) == [1, 2, 3, 4, 5, 6]
    dropped(spark, name)


def test_old_versions_stay_readable_until_vacuumed(spark):
    name = "versioned"
    dropped(spark, name)
    first = fresh_path(spark, "first")
    tables.replace_table(spark.range(1), name, first)
    old = spark.table(name)
    tables.replace_table(spark.range(2), name)
    tables.replace_table(spark.range(3).withColumn("x", F.lit(1)), name)
    assert old.count() == 1 and spark.table(tables.versions(spark, name)[2]).count() == 2
    assert tables.vacuum(spark, name, keep=2) == [1] and not folder_exists(spark, first)
    assert list(tables.versions(spark, name)) == [2, 3] and spark.table(name).count() == 3
    tables.replace_table(spark.range(4), name, keep=1)
    assert list(tables.versions(spark, name)) == [4] and spark.table(name).count() == 4
    dropped(spark, name)


def test_a_plain_table_of_the_name_becomes_its_first_version(spark):
    name = "was_plain"
    dropped(spark, name)
    spark.catalog.createTable(name, path=tables.fresh_path(spark, name), source="parquet", schema=spark.range(1).schema)
    assert tables.replace_table(spark.range(5), name).count() == 5
    assert list(tables.versions(spark, name)) == [0, 1]
    dropped(spark, name)


def test_schema_drift(spark, tmp_path):
    """Columns that stayed, widened, narrowed, turned to text, came and went."""
    path = tmp_path / "feed"
    path.mkdir()
    (path / "a.csv").write_text("id,big,word,score,extra\n1,99999999999,5,1.5,x\n2,,7,n/a,y\n")
    (path / "b.csv").write_text("id,big,word,score,extra\n3,4,8,2.5,z\n")
    contract = "id int, big int, word string, score double, gone date"
    rows = {r.column_name: r for r in tables.schema_drift(spark, str(path), StructType.fromDDL(contract)).collect()}
    assert {n: r.verdict for n, r in rows.items()} == {
        "id": "SAME", "big": "WIDENED", "word": "NARROWED", "score": "TO TEXT", "gone": "MISSING", "extra": "EXTRA",
    }
    assert (rows["big"].inferred_type, rows["big"].lost_values, rows["big"].example) == ("bigint", 1, "99999999999")
    assert (rows["score"].lost_values, rows["score"].example, rows["id"].lost_values) == (1, "n/a", 0)
    assert rows["gone"].inferred_type is None and rows["extra"].declared_type is None
    assert [r.position for r in tables.schema_drift(spark, str(path), StructType.fromDDL(contract)).collect()] == [1, 2, 3, 4, 5, 6]


@pytest.fixture(scope="module")
def layout(spark, star, tmp_path_factory):
    folder = tmp_path_factory.mktemp("layout")
    tables.write_layout(star.fact, str(folder / "ranged"), files=12)
    spark.sql("DROP TABLE IF EXISTS fact_by_customer")
    tables.write_layout(star.fact, str(folder / "bucketed"), bucket_table="fact_by_customer")
    return str(folder / "ranged")


def test_a_month_is_read_from_its_own_folders(spark, layout):
    july = spark.read.parquet(layout).where("txn_month = '1995-07'")
    text = plan(july.select("amount_cents"))
    assert "PartitionFilters: [isnotnull(txn_month" in text and "ReadSchema: struct<amount_cents:bigint>" in text
    files = july.inputFiles()  # all of the table; the scan's own number follows
    july.count()
    scanned = july.select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len(scanned) < len(files) / 4 and all("txn_month=1995-07" in r.f for r in scanned)


def test_row_groups_are_skipped_by_status(spark, layout):
    """The status reaches the scan, and the files hold it in tight ranges, so that most need not be read for the rarest one."""
    blocked = spark.read.parquet(layout).where("transaction_status = 'FRAUD_BLOCKED'")
    assert "PushedFilters: [IsNotNull(transaction_status), EqualTo(transaction_status,FRAUD_BLOCKED)]" in plan(blocked.select("amount_cents"))
    for file in list(Path(layout).rglob("*.parquet"))[:20]:
        status = pq.read_table(file, columns=["transaction_status"]).column(0).to_pylist()
        assert status == sorted(status)


def test_a_join_on_the_bucketed_customer_needs_no_exchange_of_the_fact(spark, star, layout):
    spark.sql("DROP TABLE IF EXISTS customers_by_id")
    star.customers.write.bucketBy(8, "customer_id").sortBy("customer_id").mode("overwrite").saveAsTable("customers_by_id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("fact_by_customer").join(spark.table("customers_by_id"), "customer_id")
        per_city = joined.groupBy("customer_id").agg(F.sum("amount_cents").alias("cents"))
        assert "Exchange" not in plan(per_city)
        assert per_city.count() == star.fact.select("customer_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE customers_by_id")
