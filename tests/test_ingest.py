"""By-name ingestion, rescue, lineage, inventory and the incremental stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import standardise
from tallyhouse.sources import inventory, landing, store
from tallyhouse.sources.entities import ENTITIES
from tallyhouse.streaming import ingest


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "in")
    put(r, "Region 1/customers_1.csv", "customer_id,customer_email,customer_name,segment,city,state,postal_code,region\nA,a@x,Ann,CONS,Texas,Austin,01234,N\n")
    put(r, "Region 4/customers_4.csv", "region,postal_code,customer_id,customer_name,loyalty,segment\nS,00001,B,Bob,gold,HO\n")
    put(r, "transactions_3.csv", "Order_ID,Product_ID,Sales,profit\nO1,P1,10.5,oops\nO2,P2,?,-1.5\n")
    put(r, "Region 2/transactions_2.csv", "Order_id,Product_id,Sales,profit,discount\nO3,P3,7,2,40%\n")
    put(r, "Region 6/returns_1.json", json.dumps([{"order_id": "O1", "refund_amount": "$1,130.65", "return_date": "2018-01-02"}, {"order_id": "O2", "refund_amount": 5.25, "note": {"a": 1}}], indent=2))
    put(r, "returns_2.json", '[{"OrderId": "O3", "amount": NaN, "status": "ok"}]')
    put(r, "odd/vendors.csv", "vendor_name,vendor_id\n acme ,VEN1\n")
    return r


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_columns_go_by_name_not_by_position(spark, root):
    got = rows(landing.read_entity(spark, ENTITIES["customers"], root), "customer_id")
    assert (got["A"].region, got["A"].postal_code, got["A"].customer_name) == ("N", "01234", "Ann")
    assert (got["B"].region, got["B"].postal_code, got["B"].customer_name, got["B"].customer_email) == ("S", "00001", "Bob", None)
    assert got["A"]._rescued_data is None
    assert json.loads(got["B"]._rescued_data) == {"loyalty": "gold"}


def test_rescue_of_unknown_columns_and_wrong_types(spark, root):
    raw = landing.read_entity(spark, ENTITIES["transactions"], root)
    by_sales = rows(raw, "Sales")
    assert json.loads(by_sales["10.5"]._rescued_data) == {"Order_ID": "O1", "Product_ID": "P1", "profit": "oops"}
    assert by_sales["10.5"].profit is None and by_sales["?"].profit == -1.5
    assert by_sales["7"].Order_id == "O3" and by_sales["7"]._rescued_data is None
    std = rows(standardise.transactions(raw), "order_id")
    assert std["O1"].product_id == "P1" and std["O1"].profit_was_null and std["O2"].sales is None and std["O3"].discount == 0.4


def test_multiline_json(spark, root):
    raw = landing.read_entity(spark, ENTITIES["returns"], root)
    std = rows(standardise.returns(raw), "order_id")
    assert std["O1"].refund_amount == 1130.65 and std["O2"].refund_amount == 5.25 and std["O3"].refund_amount is None
    assert std["O3"].return_status == "ok"
    rescued = {r.order_id: r._rescued_data for r in raw.filter("order_id is not null").collect()}
    assert json.loads(rescued["O2"]) == {"note": '{"a":"1"}'}


def test_lineage_and_region(spark, root):
    raw = landing.read_entity(spark, ENTITIES["transactions"], root)
    assert {(r._source_file_name, r.source_region) for r in raw.collect()} == {("transactions_3.csv", "Region 3"), ("transactions_2.csv", "Region 2")}
    assert raw.filter("_source_file_path is null or _source_modified_time is null or _ingested_at is null").count() == 0
    odd = landing.read_entity(spark, ENTITIES["vendors"], root).first()
    assert (odd.vendor_id, odd.source_region) == ("VEN1", "global")
    paths = spark.createDataFrame([("/x/Region%204/a.csv", "a.csv"), ("/x/b.csv", "b.csv")], "p string, n string")
    assert [r[0] for r in paths.select(landing.region_of(F.col("p"), F.col("n"))).collect()] == ["Region 4", "unknown"]


def test_headers_have_no_limit_and_names_may_repeat(spark, tmp_path):
    long = ",".join(f"filler_{i}_" + "x" * 1100 for i in range(80))
    put(str(tmp_path), "Region 1/customers_1.csv", f'{long},"two\nlines",customer_id,segment\n{"x," * 81}C1,Home\n')
    put(str(tmp_path), "Region 2/customers_2.csv", "customer_id,odd,odd,ODD\nC2,1,2,3\n")
    rows = {r.customer_id: r for r in landing.read_entity(spark, ENTITIES["customers"], str(tmp_path)).collect()}
    assert rows["C1"].segment == "Home"
    assert json.loads(rows["C2"]._rescued_data) == {"odd": "1", "odd#2": "2", "ODD": "3"}
    with pytest.raises(ValueError, match="ftp"):
        landing.first_lines(spark, ["ftp://host/a.csv"])


def test_json_keys_may_differ_by_case_only(spark, tmp_path):
    entity = ENTITIES["returns"]
    name = "Region 1/" + entity.glob.replace("*", "_1")
    record = [{"order_id": "O1", "Order_ID": "O2"}]
    put(str(tmp_path), name, json.dumps(record) if entity.multiline else json.dumps(record[0]))
    row = landing.read_files(spark, entity, [str(tmp_path / name)]).first()
    assert row.order_id == "O1" and json.loads(row._rescued_data) == {"Order_ID": "O2"}


def test_json_documents_of_any_shape(spark, tmp_path):
    entity = ENTITIES["returns"]
    many = {f"key_{i}": i for i in range(1000)}
    odd = [{"order_id": "A", "order_ID": "a", "Order_Id": 1.5, "refund_amount": "oops", "amount": 2}, 7, "x", {"order_id": None, "reason": {"deep": [1, {"b": True}]}}]
    texts = {
        "1": json.dumps([{"order_id": "M", **many}]),
        "2": json.dumps(odd),
        "3": json.dumps({"order_id": "single", "status": "ok", "list": ["a", 2]}),
        "4": '[{"order_id": "twice", "order_id": "second", "x": 1}, {"order_id": "next"}]',
        "5": '[{"order_id": "cut", ',
        "6": "[]",
    }
    for i, text in texts.items():
        put(str(tmp_path), f"Region {i}/returns_{i}.json", text)
    before = spark.conf.get("spark.sql.caseSensitive")
    df = landing.read_entity(spark, entity, str(tmp_path))
    assert spark.conf.get("spark.sql.caseSensitive") == before
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1
    got = [(r.source_region[-1], r.order_id, r.OrderId, r.refund_amount, r.amount, r.reason, json.loads(r._rescued_data or "{}")) for r in df.collect()]
    by = {i: [g[1:] for g in got if g[0] == i] for i in texts}
    assert by["1"] == [("M", None, None, None, None, {k: str(v) for k, v in many.items()})]
    assert by["2"] == [
        ("A", None, None, 2.0, None, {"order_ID": "a", "Order_Id": "1.5", "refund_amount": "oops"}),
        (None, None, None, None, None, {"_corrupt_record": "7"}),
        (None, None, None, None, None, {"_corrupt_record": "x"}),
        (None, None, None, None, '{"deep":"[1,{\\"b\\":true}]"}', {}),
    ]
    assert by["3"] == [("single", None, None, None, None, {"list": '["a","2"]'})]
    assert by["4"] == [("second", None, None, None, None, {"x": "1"}), ("next", None, None, None, None, {})]
    assert [g[-1]["_corrupt_record"] for g in by["5"]] == [texts["5"]] and by["6"] == []


def test_inventory(spark, root):
    files = inventory.source_files(spark, root)
    status = {r.entity: (r.systems, r.status) for r in inventory.entity_status(files).collect()}
    assert status["customers"] == (2, "OK") and status["orders"] == (0, "MISSING")
    assert inventory.completeness(files).first().complete is False
    assert inventory.completeness(files, 7).first().complete is True


def test_each_file_is_ingested_once_and_late_files_follow(spark, root, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    entity = ENTITIES["customers"]
    counts = []
    for step in range(3):
        if step == 2:
            put(root, "Region 6/customers_6.csv", "customer_identifier,full_name\nC,Cy\n")
        ingest.ingest(spark, entity, root, table, checkpoint)
        counts.append(ingest.raw_table(spark, table).count())
    assert counts == [2, 2, 3]
    stored = ingest.raw_table(spark, table)
    assert stored.filter("customer_identifier = 'C'").first().full_name == "Cy"
    metrics = {r.batch_id: (r.row_count, r.systems, r.rescued_rows) for r in ingest.load_metrics(stored).collect()}
    assert metrics == {0: (2, 2, 1), 1: (1, 1, 0)}


def test_type_inference_with_hints(spark):
    df = spark.createDataFrame([("1", "1.5", "2020-01-01 10:00:00", "007", None), ("22", "3", "2021-01-01", "08", None)], "a string, b string, c string, d string, e string")
    kinds = {r.column_name: r.inferred_type for r in landing.infer_types(df, df.columns, {"d": "string"}).collect()}
    assert kinds == {"a": "bigint", "b": "double", "c": "timestamp", "d": "string", "e": "string"}


def test_a_cluster_has_to_name_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.work_dir(Session(), "x")


def test_work_folders_are_new_and_shared(spark):
    one, two = store.work_dir(spark, "x"), store.work_dir(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))
