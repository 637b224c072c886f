import datetime as dt
import json
import pathlib
import random
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.config import Lake
from tidemark.operators import dq, gold, landing, latest, recon, silver
from tidemark.plans import daily
from tidemark.plans.selftest import run_selftest, selftest_results
from tidemark.session import scratch_path, scratch_root
from tidemark.sinks import snapshots, tables
from tidemark.sinks.objects import land_objects, manifests
from tidemark.sources.bronze import bronze_scan, jsonl_scan, object_scan
from tidemark.sources.lake import lake_table, transcript_lines

DAY = dt.date(2026, 9, 12)
TS = 1_789_200_000_000


def envelope(op, order, ts=TS, table="oms_order", region="CA", **fields):
    row = {"order_id": order, "region": region, **fields}
    return json.dumps({"op": op, "source": {"table": table, "ts_ms": ts},
                       "after": None if op == "d" else row, "before": row if op == "d" else None})


def messages(spark, values):
    rows = [("oms.cdc", 0, i, 0, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, position int, value string")


def test_latest_wins_and_delete_drops(spark):
    got = silver.silver_orders(messages(spark, [
        envelope("c", "A", 1, status="NEW"), envelope("u", "A", 3, status="DONE"), envelope("u", "A", 2, status="MID"),
        envelope("c", "B", 1), envelope("d", "B", 2), envelope("c", "C", 5), envelope("d", "C", 4),
        envelope("x", "D", 1), "{bad", envelope("c", "E", None)])).collect()
    assert {(r.order_id, r.status) for r in got} == {("A", "DONE"), ("C", None)}


def test_tie_breaks_by_numeric_offset(spark):
    values = [envelope("u", "A", 7, status=f"v{i}") for i in range(12)]
    for pick in (latest.latest_per_key, latest.latest_per_key_by_max):
        assert [r.status for r in silver.silver_orders(messages(spark, values), pick).collect()] == ["v11"]


def test_bad_numbers_become_null(spark):
    line = {"line_no": 0, "sku_id": "S", "quantity": "many", "unit_price_minor": 5, "currency": "CAD"}
    got = silver.silver_lines(messages(spark, [envelope("c", "A", table="oms_order_line", **line)])).first()
    assert got.quantity is None and got.line_total_minor is None and got.unit_price_minor == 5


def test_selftest_counts(spark):
    got = {(r.table_name, r.rule_id): (r.checked, r.violations, r.status) for r in selftest_results(spark).collect()}
    assert got == {
        ("fact_orders", "DQ-COMPLETE"): (7, 3, "FAIL"), ("fact_orders", "DQ-UNIQUE"): (7, 2, "FAIL"),
        ("fact_orders", "DQ-REFERENTIAL"): (7, 2, "FAIL"), ("fact_order_lines", "DQ-COMPLETE"): (8, 3, "FAIL"),
        ("fact_order_lines", "DQ-UNIQUE"): (8, 1, "FAIL"), ("fact_order_lines", "DQ-REFERENTIAL"): (8, 2, "FAIL")}
    assert run_selftest(spark) == 0


def test_one_pass_finds_what_single_rules_find(spark, tmp_path):
    """Random rows with null keys, repeated keys and orphans; every rule by its words, and each table read once."""
    rnd = random.Random(9)
    pick = lambda *v: rnd.choice(v)
    rows = [(i, pick("A", "B", "C", f"K{i}", f"L{i}", None), pick("S1", "S2", "S9", None), pick("CA", None),
             pick(5, None), pick("CAD", "SGD", None)) for i in range(400)]
    names = "seq int, order_id string, store_id string, region string, total_amount_minor bigint, currency string"
    spark.createDataFrame(rows, names).repartition(4).write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    stores = spark.createDataFrame([("S1",), ("S2",), ("S1",), (None,)], "store_id string")
    rules = dq.order_rules(("seq",), stores)
    first = {}
    for row in rows:
        first.setdefault(row[1], row[0])
    want = set()
    for seq, key, store, region, total, currency in rows:
        if None in (key, store, region, total, currency):
            want.add((seq, dq.COMPLETE))
        if first[key] != seq:
            want.add((seq, dq.UNIQUE))
        if store not in ("S1", "S2"):
            want.add((seq, dq.REFERENTIAL))
    judged = dq.judged(orders, rules)
    got = judged.select("seq", F.inline(dq.FOUND)).collect()
    assert judged.count() == 400 and {(r.seq, r.rule_id) for r in got} == want and len(got) == len(want)
    assert {(r.rule_id, r.checked, r.violations) for r in dq.results([(judged, rules)]).collect()} == {
        (x, 400, sum(r == x for _, r in want)) for x in (dq.COMPLETE, dq.UNIQUE, dq.REFERENTIAL)}
    bad = {key for seq, key, *_ in rows if any((seq, x) in want for x in (dq.COMPLETE, dq.UNIQUE, dq.REFERENTIAL))}
    assert {r.order_id for r in dq.passing_judged(judged, ["order_id"]).collect()} == {
        r[1] for r in rows} - bad - {None}
    plan = dq.results([(judged, rules)])._jdf.queryExecution().executedPlan().toString()
    # the rows once, and the key and position columns alone for repeated keys
    assert plan.count("FileScan parquet") == 2 and "ReadSchema: struct<seq:int,order_id:string>" in plan


def test_quarantine_excludes_key_and_null_key(spark):
    rows = spark.createDataFrame([(0, "A", 1), (1, "A", 2), (2, "B", 1), (3, None, 1)], "seq int, order_id string, x int")
    rule = dq.UniqueRule("t", ("order_id",), dq.UNIQUE, ("order_id",), ("seq",))
    found = rule.violations(rows)
    assert [r.row_key for r in found.collect()] == ["A"]
    assert [r.order_id for r in dq.passing(rows, ["order_id"], found).collect()] == ["B"]
    kept = dq.passing_keep_first(rows, rule, found.where("false")).collect()
    assert sorted((r.order_id, r.x) for r in kept) == [("A", 1), ("B", 1)]


def test_null_line_number_matches_its_violation(spark):
    lines = spark.createDataFrame([("A", None, None), ("A", 1, "S")], "order_id string, line_no int, sku_id string")
    rows = lines.select("*", F.lit(1).alias("quantity"), F.lit(5).alias("unit_price_minor"), F.lit("CAD").alias("currency"))
    found = dq.line_complete().violations(rows)
    assert [r.row_key for r in found.collect()] == ["A|null"]
    assert [r.line_no for r in dq.passing(rows, ["order_id", "line_no"], found).collect()] == [1]


def test_recon_buckets_null_currency_and_missing_side(spark):
    o = lambda rows: spark.createDataFrame(rows, "order_id string, total_amount_minor bigint, currency string")
    lines = spark.createDataFrame([], "order_id string, line_total_minor bigint, currency string")
    got = recon.in_report_order(recon.by_currency(
        o([("1", 5, "SGD"), ("2", None, None)]), lines, o([("1", 5, "SGD"), ("3", 7, "CAD")]), lines)).collect()
    assert [(r.currency, r.source_minor, r.gold_minor, r.match) for r in got] == [
        ("SGD", 5, 5, True), ("__NULL__", 0, 0, True), ("CAD", 0, 7, False)]


def lake_of(spark, values):
    lake = Lake(scratch_path(spark, "test-lake"))
    land_objects(landing.bronze_rows(landing.strict(landing.route(messages(spark, values))), "a"), lake.bronze, "a")
    return lake


def order(oid, amount=100, currency="CAD", **kw):
    return envelope("c", oid, store_id="ST-CA-01", total_amount_minor=amount, currency=currency, **kw)


def line(oid, no, qty=2, price=50):
    return envelope("c", oid, table="oms_order_line", line_no=no, sku_id="SKU-0001", quantity=qty,
                    unit_price_minor=price, currency="CAD")


def source(spark, orders, lines):
    at = dt.datetime(2026, 9, 12, 8, 0)
    o = spark.createDataFrame([(i, a, "CAD", at) for i, a in orders],
                              "order_id string, total_amount_minor bigint, currency string, ingested_at timestamp")
    ln = spark.createDataFrame([(i, t, "CAD") for i, t in lines], "order_id string, line_total_minor bigint, currency string")
    return o, ln


def test_full_run_green_then_red_then_green(spark, capsys):
    lake = lake_of(spark, [order("A"), order("B", 300), line("A", 0), line("A", 1), line("B", 0)])
    good = source(spark, [("A", 100), ("B", 300)], [("A", 100), ("A", 100), ("B", 100)])
    for _ in range(2):
        result = daily.run_full(spark, lake, DAY, *good)
        assert result.exit_code == 0 and result.rows["gold.fact_orders"] == 2
        assert lake_table(spark, lake.gold("fact_order_lines"), "20260912").count() == 3
    phantom = source(spark, [("A", 100), ("B", 300), ("P", 9999)], [("A", 100), ("A", 100), ("B", 100)])
    assert daily.recon_only(spark, lake, DAY, *phantom).exit_code == 2
    assert daily.recon_only(spark, lake, DAY, *good).exit_code == 0
    assert "BATCH-WINDOW businessDate=2026-09-12" in capsys.readouterr().out
    books = spark.read.parquet(lake.books("recon_report"))
    assert sorted(r.all_match for r in books.collect()) == [False, True, True, True]
    doc = json.loads(spark.read.text(lake.books("report_json") + "/*").first()[0])
    assert doc["businessDate"] == "2026-09-12" and set(doc) == {
        "runId", "businessDate", "orders", "lines", "totalsByCurrency", "lineTotalsByCurrency", "allMatch", "generatedAt"}
    assert spark.read.json(lake.books("metrics")).where("metric = 'batch_completion'").count() == 4


def test_full_run_quarantines_and_turns_red(spark):
    lake = lake_of(spark, [order("A"), order("B", None), line("A", 0), line("B", 0), line("Z", 0), line("A", 1, qty=0)])
    result = daily.run_full(spark, lake, DAY, *source(spark, [("A", 100), ("B", 5)], [("A", 100), ("B", 100)]))
    assert result.exit_code == 2 and result.rows["gold.fact_order_lines"] == 1
    found = {(r.rule_id, r.row_key) for r in spark.read.parquet(lake.books("dq_quarantine")).collect()}
    assert found == {("DQ-COMPLETE", "B"), ("DQ-COMPLETE", "A|1"), ("DQ-REFERENTIAL", "B|0"), ("DQ-REFERENTIAL", "Z|0")}
    assert "quaranted_at" in spark.read.parquet(lake.books("dq_quarantine")).columns


def test_missing_day_is_an_error(spark):
    lake = lake_of(spark, [order("A")])
    with pytest.raises(FileNotFoundError, match="BRONZE-READ-FAILED dt=20200101"):
        object_scan(spark, lake.bronze, "20200101")
    with pytest.raises(FileNotFoundError, match="BRONZE-READ-FAILED"):
        bronze_scan(spark, lake.bronze + "-none", "20200101")


def test_plain_jsonl_objects(spark, tmp_path):
    folder = tmp_path / "region=CA" / "table=oms_order" / "dt=20260912"
    folder.mkdir(parents=True)
    for offset, status in ((9, "OLD"), (10, "NEW")):
        (folder / f"oms.cdc-0-{offset}-{uuid.uuid4()}.jsonl").write_text(envelope("u", "A", status=status) + "\n")
    scanned = jsonl_scan(spark, str(tmp_path), "20260912")
    assert {(r.topic, r.partition, r.offset) for r in scanned.collect()} == {("oms.cdc", 0, 9), ("oms.cdc", 0, 10)}
    assert silver.silver_orders(scanned).first().status == "NEW"
    with pytest.raises(FileNotFoundError):
        jsonl_scan(spark, str(tmp_path), "20260101")


def test_objects_without_a_manifest_are_not_read(spark):
    """A stopped attempt, a retried landing, lines with breaks, and ties within one object."""
    lake = lake_of(spark, [envelope("c", "A", status="OLD"), envelope("u", "A", status="NEW"), order("B")])
    stray = f"{lake.bronze}/region=CA/table=oms_order/dt=20260912/oms.cdc-0-7-{uuid.uuid4()}.jsonl"
    with open(stray, "w") as out:
        out.write(order("LOST") + "\n")
    assert jsonl_scan(spark, lake.bronze).count() == 4
    found = object_scan(spark, lake.bronze, "20260912", "oms_order")
    assert found.count() == 3 and landing.bad_object_keys(found).count() == 0
    assert silver.silver_orders(found).where("order_id = 'A'").first().status == "NEW"
    pretty = json.dumps(json.loads(order("C")), indent=1)
    for _ in range(2):
        land_objects(landing.bronze_rows(landing.route(messages(spark, [pretty])), "b"), lake.bronze, "b")
    assert silver.silver_orders(object_scan(spark, lake.bronze)).where("order_id = 'C'").count() == 1
    assert object_scan(spark, lake.bronze).count() == 4
    assert sorted(r.records for r in manifests(spark, lake.bronze).collect()) == [1, 3]
    none = landing.bronze_rows(landing.route(messages(spark, [pretty])), "c").where("false")
    land_objects(none, lake.bronze, "b")  # a landing that is repeated without rows is empty
    assert object_scan(spark, lake.bronze).count() == 3


def test_packed_objects_are_small_and_read_as_the_others(spark):
    rows = [order(f"K{i}") for i in range(400)]
    plain = lake_of(spark, rows)
    packed = Lake(scratch_path(spark, "lake"))
    land_objects(landing.bronze_rows(landing.strict(landing.route(messages(spark, rows))), "a"), packed.bronze, "a",
                 packed=True)
    files = [list(pathlib.Path(lake.bronze).rglob("oms.cdc-*")) for lake in (plain, packed)]
    assert all(f.name.endswith(".jsonl.gz") for f in files[1]) and not any(f.suffix == ".gz" for f in files[0])
    assert 5 * sum(f.stat().st_size for f in files[1]) < sum(f.stat().st_size for f in files[0])
    found = object_scan(spark, packed.bronze, "20260912", "oms_order")
    assert found.count() == 400 and landing.bad_object_keys(found).count() == 0
    columns = ("topic", "partition", "position", "value", "region", "table", "dt")
    assert found.select(*columns).exceptAll(object_scan(spark, plain.bronze).select(*columns)).count() == 0
    assert sum(r.records for r in manifests(spark, packed.bronze).collect()) == 400


def test_objects_are_bounded(spark, monkeypatch):
    from tidemark.sinks import objects

    writer = objects.ObjectWriter(objects.Target(scratch_path(spark, "objects"), "x"))
    monkeypatch.setattr(objects, "OBJECT_RECORDS", 4)
    rows = [("CA", "t", "20260912", "oms.cdc", i // 6, i, "{}") for i in range(12)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip((*objects._GROUP, "offset", "value"), r)) for r in rows])
    found = writer.write(iter([batch])).found
    assert [(f["partition"], f["first_offset"], f["last_offset"], f["records"]) for f in found] == [
        (0, 0, 3, 4), (0, 4, 5, 2), (1, 6, 9, 4), (1, 10, 11, 2)]


def test_silver_takes_the_named_fields_and_the_key_of_a_deleted_row(spark):
    rows = messages(spark, [order("A"), order("B"), envelope("d", "B", ts=10**15)])
    whole, some = silver.silver_orders(rows), silver.silver_orders(rows, fields=("currency", "status"))
    assert some.columns == ["currency", "status", "source_ts_ms"]
    assert [r.order_id for r in whole.collect()] == ["A"]
    assert some.collect() == whole.select("currency", "status", "source_ts_ms").collect()


def test_orders_of_a_comparison_are_read_from_messages_once(spark):
    from tidemark.queries import lake as lake_queries
    from tidemark.sources.adapters import Tables

    plan = lake_queries.recon_frames(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_json") == 1  # that of the lines


def test_lines_of_a_roundtrip_are_computed_once(spark, monkeypatch):
    from tidemark.queries import jobs as job_queries
    from tidemark.sources.adapters import Tables

    plans, replace_day = [], job_queries.tables.replace_day

    def seen(df, path, day):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return replace_day(df, path, day)

    monkeypatch.setattr(job_queries.tables, "replace_day", seen)
    job_queries.silver_gold_roundtrip(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert len(plans) == 5 and not any("Aggregate" in p or "Join" in p for p in plans)


def test_messages_of_a_landing_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    rows = landing.bronze_rows(landing.route(messages(spark, [order(f"K{i}") for i in range(50)])), "a")
    lake = Lake(scratch_path(spark, "lake"))
    land_objects(rows.withColumn("value", F.udf(seen)("value")), lake.bronze, "a")
    assert made.value == 50 and object_scan(spark, lake.bronze).count() == 50


def test_objects_go_on_over_batches_and_close_by_bytes(spark, monkeypatch):
    from tidemark.sinks import objects
    import pyarrow as pa

    writer = objects.ObjectWriter(objects.Target(scratch_path(spark, "objects"), "x"))
    monkeypatch.setattr(objects, "OBJECT_BYTES", 10)
    values = ["aa", "b\r\nb", "c", "x" * 30, "", "é", "ddddd", "eeeeee"]
    rows = [("CA", "t", "20260912", "oms.cdc", 0, i, v) for i, v in enumerate(values)]
    batch = lambda part: pa.RecordBatch.from_pylist(
        [dict(zip((*objects._GROUP, "offset", "value"), r)) for r in part],
        schema=pa.schema([*[(c, pa.string()) for c in objects._GROUP[:4]], ("partition", pa.int32()),
                          ("offset", pa.int64()), ("value", pa.string())]))
    found = writer.write(iter([batch(rows[:2]), batch([]), batch(rows[2:])])).found
    assert [(f["first_offset"], f["last_offset"], f["records"], f["bytes"]) for f in found] == [
        (0, 2, 3, 9), (3, 3, 1, 31), (4, 6, 3, 10), (7, 7, 1, 7)]
    text = [pathlib.Path(writer.target.root, f["object"]).read_text() for f in found]
    assert text == ["aa\nb b\nc\n", "x" * 30 + "\n", "\né\nddddd\n", "eeeeee\n"]


def test_strict_landing_stops_on_a_foreign_region(spark):
    routed = landing.route(messages(spark, [envelope("c", "A", region="EU")]))
    with pytest.raises(Exception, match="BRONZE-REJECT region=EU"):
        landing.bronze_rows(landing.strict(routed), "a").collect()


def test_object_keys_follow_the_contract(spark):
    rows = landing.bronze_rows(landing.route(messages(spark, [order("A"), line("A", 0)])), "a")
    assert landing.bad_object_keys(rows).count() == 0
    again = landing.bronze_rows(landing.route(messages(spark, [order("A"), line("A", 0)])), "b")
    assert rows.select("object_key").intersect(again.select("object_key")).count() == 0


def test_transcript_file_counts_broken_lines(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"ts":"2026-01-01T00:00:00.000Z","n":1,"kind":"probe","ref":"R","status":201,"time_ms":4.0}\n{"ts"\n')
    rows = transcript_lines(spark, str(path)).cache()
    assert rows.where("_corrupt_record is not null").count() == 1 and rows.count() == 2


def session_with(**values):
    names = {k.replace("_", "."): v for k, v in values.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: names.get(key, default)))


def test_scratch_is_the_shared_folder_and_local_only_on_one_machine():
    shared = session_with(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    assert scratch_root(shared) == "hdfs:///shared"
    assert scratch_path(shared, "x").startswith("hdfs:///shared/x-")
    assert scratch_root(session_with(spark_master="local[2]")).startswith("/tmp/spark-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session_with(spark_master="yarn"))


def test_star_has_five_tables(spark):
    o = silver.silver_orders(messages(spark, [order("A")]))
    ln = silver.silver_lines(messages(spark, [line("A", 0)]))
    star = gold.star(spark, o, ln, DAY)
    assert {k: v.count() for k, v in star.items()} == dict.fromkeys(
        ("fact_orders", "fact_order_lines", "dim_sku", "dim_store", "dim_date"), 1)
    assert tuple(star["dim_date"].first()) == (20260912, DAY, 6, "20260912")


def test_calendar_rows(spark):
    from tidemark.sources.lake import date_rows

    got = gold.dim_dates(date_rows(spark, "2026-12-30", "2027-01-02")).collect()
    assert [(r.date_key, r.day_of_week) for r in got] == [(20261230, 3), (20261231, 4), (20270101, 5), (20270102, 6)]


def test_located_rows_explain_every_difference(spark):
    source = [("a", 1, "CAD"), ("b", 2, "CAD"), ("c", 3, "SGD"), ("d", None, None), (None, 5, "CAD"), ("e", 6, "CAD"),
              ("e", 6, "CAD"), ("f", 7, "CNY")]
    gold_ = [("a", 1, "CAD"), ("b", 2, "SGD"), ("d", None, None), (None, 4, "CAD"), ("e", 6, "CAD"), ("g", 8, "CNY"),
             ("f", 7, "CNY"), ("f", 7, "CNY")]
    frames = [spark.createDataFrame(rows, "order_id string, minor long, currency string") for rows in (source, gold_)]
    for buckets in (1, 4096):
        found = recon.locate(*frames, ("order_id",), ("minor", "currency"), buckets).collect()
        assert {tuple(r) for r in found} == {
            ("b", "CHANGED", 1, 1), ("c", "LOST", 1, 0), (None, "CHANGED", 1, 1), ("e", "LOST", 1, 0),
            ("g", "INVENTED", 0, 1), ("f", "INVENTED", 0, 1)}
    assert recon.locate(frames[0], frames[0], ("order_id",), ("minor", "currency")).count() == 0
    empty = frames[0].where("false")
    assert recon.locate(frames[0], empty, ("order_id",), ("minor", "currency")).count() == 7
    assert recon.locate(empty, empty, ("order_id",), ("minor", "currency")).count() == 0


def test_only_differing_buckets_are_listed(spark):
    source = spark.range(20_000).selectExpr("id AS k", "id * 3 AS minor", "'CAD' AS currency")
    changed = source.withColumn("minor", F.expr("minor + int(k IN (7, 11))"))
    wrong = recon.bucket_checksums(source, changed, ("k",), ("minor", "currency")).collect()
    assert 1 <= len(wrong) <= 2 and sum(r.source_rows for r in wrong) < 60


def test_snapshots_do_not_change(spark, tmp_path):
    root, at = str(tmp_path / "landing"), dt.datetime(2026, 9, 12)
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "v long")
    hour = dt.timedelta(hours=1)
    assert snapshots.commit_batch(rows(1, 2), root, "a", 0, at)
    assert snapshots.commit_batch(rows(3), root, "b", 0, at + hour)
    assert snapshots.commit_batch(rows().limit(0), root, "b", 1, at + hour)
    assert not snapshots.commit_batch(rows(1, 2, 9), root, "a", 0, at + 2 * hour)
    rows(8).write.parquet(f"{root}/data/stream=a/batch_id=1")  # an attempt that ended before its log entry
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(snapshots.as_of(spark, root, at)) == [1, 2]
    assert values(snapshots.as_of(spark, root, at + 3 * hour)) == [1, 2, 3]
    assert values(snapshots.between(spark, root, at, at + hour)) == [3]
    assert values(snapshots.between(spark, root, at + hour, at + 2 * hour)) == []
    assert snapshots.commit_batch(rows(7), root, "a", 1, at + 2 * hour)
    assert values(snapshots.between(spark, root, at + hour, at + 2 * hour)) == [7]
    grown = snapshots.growth(spark, root, at, at + 2 * hour, (), F.col("v") > 5).first()
    assert tuple(grown) == (2, 4, 2, 1)
