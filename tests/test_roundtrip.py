"""Round trips on tables of our own: what is rendered and scanned in one piece must not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from impactlake.plans import contract, index, roundtrip
from impactlake.plans.lifts import Lift
from impactlake.scratch import cut

from .oracle import same

ORDERS, PARTS = 3000, 1500


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Customers that are all multiples of 64, one with most orders, and orders without a customer."""
    d = str(tmp_path_factory.mktemp("roundtrip"))
    k = F.col("id")
    customer = F.when(k % 100 == 7, None).when(k % 3 > 0, F.lit(64)).otherwise((k % 40) * 64).cast("long")
    spark.range(ORDERS).select(k.alias("o_orderkey"), customer.alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
    flag = F.element_at(F.array(*map(F.lit, "RAN")), (k % 3 + 1).cast("int"))
    spark.range(2 * ORDERS).select((k * 7 % (ORDERS + 9)).alias("l_orderkey"), (k * 11 % (PARTS + 9)).alias("l_partkey"), (k % 5).cast("int").alias("l_linenumber"), flag.alias("l_returnflag")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(PARTS).select(k.alias("p_partkey")).write.parquet(f"{d}/part.parquet")
    return d


@pytest.fixture
def duckdb_tables(tables, monkeypatch):
    import duckdb

    from . import oracle

    def connect(sf_dir):
        con = duckdb.connect()
        for name in ("orders", "lineitem", "part"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
        return con

    monkeypatch.setattr(oracle, "connect", connect)
    return tables


def test_files_hold_a_bounded_number_of_orders_and_parts(spark, tables):
    texts = [r["text"] for r in roundtrip.render(Lift(spark, tables)).collect()]
    functions, globals_ = ([t.count(word) for t in texts] for word in ("void fn_", "int g_"))
    assert sum(functions) == ORDERS and max(functions) <= 1 << roundtrip.FILE_BITS
    assert sum(globals_) == PARTS and max(globals_) <= 1 << roundtrip.FILE_BITS


def test_scans_hand_back_bounded_batches():
    sizes = [b.num_rows for b in index._batches((("a", i) for i in range(2 * index.OUT_ROWS + 1)), "path string, line int")]
    assert sizes == [index.OUT_ROWS, index.OUT_ROWS, 1]


def no_walk(*_, **__):
    raise AssertionError("a table of declarations needs no walk")


def test_globals_come_without_a_walk(spark, duckdb_tables, monkeypatch):
    monkeypatch.setattr(index, "walk", no_walk)
    same(spark, contract.QUERIES["roundtrip_globals"], contract.ORACLE_SQL["roundtrip_globals"], duckdb_tables)


def test_functions_come_without_a_walk(spark, duckdb_tables, monkeypatch):
    monkeypatch.setattr(index, "walk", no_walk)
    same(spark, contract.QUERIES["roundtrip_functions"], contract.ORACLE_SQL["roundtrip_functions"], duckdb_tables)


@pytest.mark.parametrize("name", ["access", "unresolved", "call_edge"])
def test_one_table_is_that_of_the_whole_index(spark, name):
    from .test_scanner import MAIN, SHARED, rows

    files = spark.createDataFrame([("p/shared.h", SHARED, 0), ("p/main.c", MAIN, 1)], "path string, text string, ordinal long")
    threads = spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    whole, one = (index.CodeIndex.build(files, threads, {"USE_EXTRA": "", "LIMIT": "3"}, broadcast_bytes=b, only=only).tables[name] for b, only in ((1 << 20, None), (0, name)))
    assert rows(one, *whole.columns) == rows(whole, *whole.columns) != []


@pytest.mark.parametrize("broadcast_bytes", [index.BROADCAST_BYTES, 0])
def test_accesses_of_large_customers(spark, duckdb_tables, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(index.CodeIndex.build.__func__, "__defaults__", tuple(broadcast_bytes if v == index.BROADCAST_BYTES else v for v in index.CodeIndex.build.__func__.__defaults__))
    same(spark, contract.QUERIES["roundtrip_accesses"], contract.ORACLE_SQL["roundtrip_accesses"], duckdb_tables)


def test_calls_of_large_customers(spark, duckdb_tables, monkeypatch):
    build = index.CodeIndex.build
    monkeypatch.setattr(index.CodeIndex, "build", lambda *a, **b: build(*a, broadcast_bytes=0, **b))
    same(spark, contract.QUERIES["roundtrip_calls"], contract.ORACLE_SQL["roundtrip_calls"], duckdb_tables)


def test_address_notes_of_large_customers(spark, duckdb_tables, monkeypatch):
    build = index.CodeIndex.build
    monkeypatch.setattr(index.CodeIndex, "build", lambda *a, **b: build(*a, broadcast_bytes=0, **b))
    same(spark, contract.QUERIES["roundtrip_address_notes"], contract.ORACLE_SQL["roundtrip_address_notes"], duckdb_tables)


def texts(spark, n):
    return spark.range(n).select(F.concat(F.lit("f"), "id", F.lit(".c")).alias("path"), F.repeat(F.lit("int g; "), 1000).alias("text")).coalesce(1)


def test_scans_of_a_large_code_base_get_parts_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(index, "SCAN_BYTES", 50_000)
    assert index.dealt(texts(spark, 100))[0].rdd.getNumPartitions() == 1  # small: left as it is
    monkeypatch.setattr(index, "WHOLE_BYTES", 500_000)
    files, length = index.dealt(texts(spark, 100))
    assert length == 700_000 and files.rdd.getNumPartitions() == length // index.SCAN_BYTES
    assert files.select("path").distinct().count() == 100


def test_contexts_meet_files_in_parts_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(index, "SCAN_BYTES", 50_000)
    files = texts(spark, 100)
    declared = spark.createDataFrame([("f0.c", 0, "global", "g", 1, '{"name": "g", "type_name": "int", "is_array": false, "pointer_level": 0}', None)], index.DECLARED)
    met = index.with_context(files, declared, 700_000, ("access",))
    assert met.rdd.getNumPartitions() == 700_000 // index.SCAN_BYTES
    assert met.where(F.col("context").contains('"g"')).count() == 100


def test_rendered_text_is_stored_in_bounded_row_groups(spark, tables, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(roundtrip, "SCAN_BYTES", 1 << 10)
    monkeypatch.setattr(roundtrip, "cut", lambda df, **b: kept.append(cut(texts(spark, 400), **b)) or kept[0])
    roundtrip._table(Lift(spark, tables), "function")
    groups = [f.metadata.row_group(i).num_rows for path in glob.glob(kept[0].inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet") for f in [pq.ParquetFile(path)] for i in range(f.num_row_groups)]
    assert sum(groups) == 400 and max(groups) < 400
