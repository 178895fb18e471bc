import csv
import os
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from conftest import small_splits
from pactline.sources.contracts import Contract, contract_from_yaml, contract_rows, explode_columns, read_contract_files
from pactline.sources.resolve import parse_uri, profile, resolve


@pytest.mark.parametrize(
    "uri, kind, path",
    [
        ("local://data/file.csv", "local", "data/file.csv"),
        ("local:///abs/file.csv", "local", "/abs/file.csv"),
        ("data/file.csv", "local", "data/file.csv"),
        ("s3://bucket/key.parquet", "s3", "bucket/key.parquet"),
        ("table://warehouse.fact_orders", "table", "warehouse.fact_orders"),
        ("query://SELECT 1 AS x", "query", "SELECT 1 AS x"),
        ("partition://s3://bucket/dt=2026-08-19/", "partition", "s3://bucket/dt=2026-08-19/"),
        ("unknown://some/path", "local", "unknown://some/path"),
    ],
)
def test_uri_kinds(uri, kind, path):
    ref = parse_uri(uri)
    assert (ref.kind, ref.path) == (kind, path)


def test_bare_path_gets_local_scheme():
    assert parse_uri("a.csv").uri == "local://a.csv"
    assert parse_uri("unknown://x").uri == "unknown://x"


def test_local_text(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("order_id,amount\nORD-001,100.00\n\nORD-002,\n", encoding="utf-8")
    found = resolve(spark, f"local://{path}")
    assert found.readable and found.columns == ("order_id", "amount")
    assert [tuple(r) for r in found.frame.collect()] == [("ORD-001", "100.00"), ("ORD-002", None)]
    row = profile(found).first()
    assert (row["row_count"], row["column_count"], row["columns"]) == (2, 2, ["order_id", "amount"])
    assert row["source_uri"] == f"local://{path}"


def test_quotes_and_line_breaks(spark, tmp_path):
    rows = [["1", 'He said "hi", ok'], ["2", "two\nlines"], ["3", "a,b"], ["4", 'x"']]
    path = tmp_path / "quoted.csv"
    with path.open("w", newline="", encoding="utf-8") as file:
        csv.writer(file).writerows([["id", "text"], *rows])
    found = resolve(spark, str(path))
    assert [list(r) for r in found.frame.collect()] == rows


def test_large_files_stay_splittable_unless_a_quote_runs_on(spark, tmp_path):
    clean, broken = tmp_path / "clean.csv", tmp_path / "broken.csv"
    clean.write_text("id,text\n" + "".join(f'{i},"say ""{i}"""\n' for i in range(500)))
    broken.write_text("id,text\n" + "".join(f'{i},"say\n{i}"\n' for i in range(500)))
    with small_splits(spark):
        split = resolve(spark, str(clean))
        whole = resolve(spark, str(broken))
        assert split.placed is not None and split.frame.rdd.getNumPartitions() > 1
        assert whole.placed is None and whole.row_number is not None
        assert split.frame.count() == 500
        assert split.frame.where(F.col("text") == 'say "7"').count() == 1
        assert whole.frame.count() == 500
        assert whole.frame.where(F.col("text") == "say\n7").count() == 1


def test_missing_empty_and_folder(spark, tmp_path):
    assert "not found" in resolve(spark, "local:///nonexistent/file.csv").error.lower()
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert resolve(spark, str(empty)).error == "File is empty"
    header = tmp_path / "header.csv"
    header.write_text("a,b\n")
    assert resolve(spark, str(header)).error == "File is empty"
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part.csv").write_text("a\n1\n")
    assert resolve(spark, str(tmp_path / "folder")).error.startswith("Not a file")


def test_odd_file_names(spark, tmp_path):
    path = tmp_path / "a b%20c.csv"
    path.write_text("id\n1\n")
    found = resolve(spark, str(path))
    assert found.error is None and found.placed is not None and found.frame.count() == 1


def test_object_store(spark, tmp_path):
    os.makedirs(tmp_path / "bucket" / "raw")
    (tmp_path / "bucket" / "raw" / "orders.csv").write_text("id,amount\n1,2.5\n")
    (tmp_path / "bucket" / "raw" / "none.csv").write_text("id,amount\n")
    store = f"file://{tmp_path}/"
    assert resolve(spark, "s3://bucket/raw/orders.csv", object_store=store).frame.count() == 1
    assert resolve(spark, "s3://bucket/raw/none.csv", object_store=store).error == "S3 object is empty"
    assert resolve(spark, "s3://bucket", object_store=store).error == "Invalid S3 path: bucket"
    assert not resolve(spark, "s3://bucket/raw/absent.csv", object_store=store).readable


def test_unknown_file_system_is_an_error_not_an_exception(spark):
    assert not resolve(spark, "nosuchfs://some/path.csv").readable


def test_table_and_query(spark):
    spark.range(3).createOrReplaceTempView("three")
    spark.range(0).createOrReplaceTempView("nothing")
    assert resolve(spark, "table://three").frame.count() == 3
    assert resolve(spark, "query://SELECT id * 2 AS x FROM three").columns == ("x",)
    assert resolve(spark, "table://nothing").readable
    assert resolve(spark, "table://absent").error.startswith("Failed to query table")
    assert resolve(spark, "query://SELEC 1").error.startswith("Failed to execute query")


def test_tables_are_read_whole(spark):
    spark.range(25_000).createOrReplaceTempView("many")
    assert profile(resolve(spark, "table://many")).first()["row_count"] == 25_000


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_partitioned_folders(spark, tmp_path, kind):
    rows = spark.range(100).selectExpr("id", "'2026-08-' || (10 + id % 3) AS dt")
    rows.write.option("header", "true").partitionBy("dt").format(kind).save(str(tmp_path / "data"))
    whole = resolve(spark, f"partition://{tmp_path}/data")
    assert whole.columns == ("id",) and whole.partition_columns == ("dt",)
    assert whole.frame.count() == 100
    one = resolve(spark, f"partition://{tmp_path}/data/dt=2026-08-11/")
    assert one.frame.count() == 33 and one.partition_columns == ("dt",)
    plan = whole.frame.where("dt = '2026-08-11'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_partition_of_object_store(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "bucket" / "dt=2026-08-19"))
    found = resolve(spark, "partition://s3://bucket/dt=2026-08-19/", object_store=f"file://{tmp_path}/")
    assert found.frame.count() == 5


def test_contract_defaults():
    contract = Contract.from_documents({"a": {}, "b": {"type": "integer", "nullable": False}})
    assert [(c.name, c.type, c.nullable) for c in contract.columns] == [
        ("a", "string", True),
        ("b", "integer", False),
    ]
    assert (contract.max_age_hours, contract.timestamp_column) == (24, "snapshot_date")
    assert (contract.min_row_count, contract.max_row_count, contract.max_row_count_diff_pct) == (0, None, 100)
    assert contract.unique_keys == ()


CONTRACT_YAML = """
pipeline_name: shop
dataset_name: stock
contract_version: 3
freshness: {max_age_hours: 12, timestamp_column: day}
schema:
  day: {type: date, nullable: false}
  note: {type: string}
quality: {unique_keys: [day], max_row_count: 9}
"""


def test_contract_yaml():
    pytest.importorskip("yaml")
    pipeline, dataset, contract = contract_from_yaml(CONTRACT_YAML)
    assert (pipeline, dataset, contract.version, contract.unique_keys) == ("shop", "stock", 3, ("day",))
    assert contract.column_names == ("day", "note") and contract.max_row_count == 9


def test_contract_table_and_files(spark, tmp_path):
    entry = {
        "pipeline": "shop",
        "dataset": "stock",
        "version": 2,
        "schema_definition": {"id": {"type": "integer", "nullable": False}, "x": {}},
        "freshness": {"max_age_hours": 6},
        "quality_rules": {"min_row_count": 4},
    }
    rows = contract_rows(spark, [entry])
    contract = Contract.from_row(rows.first())
    assert (contract.version, contract.max_age_hours, contract.min_row_count) == (2, 6, 4)
    columns = explode_columns(rows).orderBy("position").collect()
    assert [(r["column"], r["type"], r["nullable"]) for r in columns] == [
        ("id", "integer", False),
        ("x", "string", True),
    ]
    (tmp_path / "c.json").write_text(
        '{"pipeline_name": "shop", "dataset_name": "stock", "contract_version": 1,\n'
        '"schema": {"id": {"type": "integer", "nullable": false}}, "quality": {"min_row_count": 2}}'
    )
    read = Contract.from_row(read_contract_files(spark, str(tmp_path)).first())
    assert read.column_names == ("id",) and read.min_row_count == 2


AWKWARD = [
    # lines of blanks are rows, empty lines are none; any line end; quotes inside; missing and surplus fields
    'k,v\n1,a\n  \n\n2,"x ""y"" z"\r\n3,5"\n4\n5,e,extra\n\r6,f\r7,g\n',
    "k,v\n" + "".join(f"{i},w\n \n" for i in range(300)),
    "k,v\nk,v\n1,2\n",
]


def reader_rows(text):
    """What Python's reader makes of a file, by column name; absent and empty fields alike."""
    rows = list(csv.DictReader(text.splitlines(keepends=True)))
    return [tuple(r[c] or None for c in ("k", "v")) for r in rows]


@pytest.mark.parametrize("text", AWKWARD)
@pytest.mark.parametrize("small", [True, False])
def test_rows_of_a_file_do_not_depend_on_its_size(spark, tmp_path, text, small):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    with small_splits(spark) if small else nullcontext():
        found = {m: resolve(spark, str(path), multi_line=m).frame.collect() for m in (None, False)}
    assert all(sorted(map(tuple, rows), key=repr) == sorted(reader_rows(text), key=repr) for rows in found.values())
    if "\r" not in text:
        whole = resolve(spark, str(path), multi_line=True).frame.collect()
        assert sorted(map(tuple, whole), key=repr) == sorted(reader_rows(text), key=repr)


def test_columns_by_header_name(spark, tmp_path):
    for day, text in {1: "k,v\n1,one\n", 2: "v,k\ntwo,2\n", 3: "k,v,extra\n3,three,x\n"}.items():
        (tmp_path / "d" / f"day={day}").mkdir(parents=True)
        (tmp_path / "d" / f"day={day}" / "f.csv").write_text(text)
    found = resolve(spark, f"partition://{tmp_path}/d")
    assert found.columns == ("k", "v", "extra") and found.partition_columns == ("day",)
    rows = sorted((r.k, r.v, r.extra, r.day) for r in found.frame.collect())
    assert rows == [("1", "one", None, 1), ("2", "two", None, 2), ("3", "three", "x", 3)]


def test_columns_of_any_parquet_partition(spark, tmp_path):
    spark.range(2).selectExpr("id AS k").write.parquet(f"{tmp_path}/p/day=1")
    spark.range(2).selectExpr("id AS k", "id AS extra").write.parquet(f"{tmp_path}/p/day=2")
    assert resolve(spark, f"partition://{tmp_path}/p").columns == ("k", "extra")
    (tmp_path / "p" / "day=2" / "x.csv").write_text("k\n1\n")
    assert "mixed" in resolve(spark, f"partition://{tmp_path}/p").error


def test_repeated_header_names_and_foreign_text(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,a\n1,2,3\n")
    found = resolve(spark, str(tmp_path / "r.csv"))
    assert found.columns == ("a", "b") and tuple(found.frame.first()) == ("3", "2")
    (tmp_path / "f.csv").write_bytes(b"a,b\n1,\xe9\n")
    assert resolve(spark, str(tmp_path / "f.csv")).error == "Failed to read file: text is not valid UTF-8"


def test_names_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('"a\nb",c,"d ""q""\n\nlast"\n1,"x\ny",3\n4,,6\n')
    found = resolve(spark, str(path))
    assert found.columns == ("a\nb", "c", 'd "q"\n\nlast')
    assert sorted(map(tuple, found.frame.collect())) == [("1", "x\ny", "3"), ("4", None, "6")]


def test_partitions_whose_broken_headers_differ_below_the_first_line(spark, tmp_path):
    for name, header, row in (("p=1", 'k,"a\nb"', "1,2"), ("p=2", '"z\ny",k', "3,4"), ("p=3", 'k,"a\nc"', "5,6"), ("p=4", "k", "7")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(f"{header}\n{row}\n")
    found = resolve(spark, f"partition://{tmp_path}")
    assert set(found.columns) == {"k", "a\nb", "z\ny", "a\nc"}
    rows = {r["k"]: (r["a\nb"], r["a\nc"], r["z\ny"]) for r in found.frame.collect()}
    assert rows == {"1": ("2", None, None), "4": (None, None, "3"), "5": (None, "6", None), "7": (None, None, None)}


def test_a_header_alone_with_line_breaks_has_no_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('"a\nb",c\n')
    found = resolve(spark, str(path))
    assert found.columns == ("a\nb", "c") and found.frame.isEmpty()
