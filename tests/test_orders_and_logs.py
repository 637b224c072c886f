import collections
import datetime as dt
import json
import pathlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import asof, events, ingest, orders, transcripts
from tidemark.queries import QUERIES
from tidemark.queries.orders import canonical_requests
from tidemark.sinks import store
from tidemark.sources.adapters import Tables
from tidemark.streaming.jobs import IdleHeartbeat


def event(**change):
    body = {"orderId": "O-1", "externalOrderRef": "W-1", "region": "CA", "audit": {"sourceSystem": "WEB"},
            "totalAmount": {"amountMinor": 10, "currency": "CAD"}, "unitPrices": [],
            "lines": [{"skuId": "S", "quantity": 1, "unitPriceMinor": 10, "currency": "CAD"}]}
    body.update(change)
    return json.dumps({k: v for k, v in body.items() if v != "DROP"})


def parsed(spark, *values):
    rows = [("t", 0, i, dt.datetime(2026, 1, 1), v) for i, v in enumerate(values)]
    return ingest.parse_events(spark.createDataFrame(
        rows, "topic string, partition int, offset bigint, timestamp timestamp, value string"))


def stored_refs(spark, path):
    return sorted(r.external_order_ref for r in store.stored_events(spark, f"{path}/events").collect())


def messages_of(spark, *refs):
    rows = [("t", 0, i, dt.datetime(2026, 1, 1), event(externalOrderRef=ref)) for i, ref in enumerate(refs)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp timestamp, value string")


def test_retried_batch_leaves_no_stale_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    many = [f"W-{i}" for i in range(40)]
    store.store_batch(messages_of(spark, *many), path, 0, "a")
    store.store_batch(messages_of(spark, "W-0"), path, 0, "a")
    assert stored_refs(spark, path) == ["W-0"]
    # what the first attempt had stored is no longer known, so it is no replay
    store.store_batch(messages_of(spark, *many), path, 1, "a")
    assert stored_refs(spark, path) == sorted(many)


def test_batch_without_keys_is_followed_by_others(spark, tmp_path):
    path = str(tmp_path / "store")
    store.store_batch(messages_of(spark), path, 0, "a")
    store.store_batch(messages_of(spark, "W-1", "W-1"), path, 1, "a")
    store.store_batch(messages_of(spark, "W-1", "W-2"), path, 0, "b")
    assert stored_refs(spark, path) == ["W-1", "W-2"]


def test_a_batch_is_parsed_to_disk_and_its_scratch_is_emptied(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("a batch is kept in memory")

    monkeypatch.setattr(type(spark.range(1)), "persist", refuse)
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path / "scratch"))
    store.store_batch(messages_of(spark, "W-1", "W-1", "W-2"), str(tmp_path / "store"), 0, "a")
    assert stored_refs(spark, str(tmp_path / "store")) == ["W-1", "W-2"]
    left = list((tmp_path / "scratch").glob("routed-*"))
    assert len(left) == 1 and spark.read.parquet(str(left[0])).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("name", ["event_store_replay", "ingest_outcomes"])
def test_messages_of_repeated_batches_are_made_once(spark, monkeypatch, name):
    plans = []
    keep = store.store_batch
    monkeypatch.setattr(store, "store_batch", lambda rows, *more: plans.append(plan_of(rows)) or keep(rows, *more))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(plans) >= 2 and not any("to_json" in plan or "structstojson" in plan for plan in plans)


@pytest.mark.parametrize("name", ["event_store_replay", "ingest_outcomes"])
def test_messages_of_repeated_batches_are_parsed_once(spark, monkeypatch, name):
    parses, wide = [], []
    parse, first = ingest.parse_events, ingest.first_events
    monkeypatch.setattr(ingest, "parse_events", lambda rows: parses.append(1) or parse(rows))
    monkeypatch.setattr(ingest, "first_events", lambda rows: wide.append("value" in rows.columns) or first(rows))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(parses) == 1
    # batches after the first look for what is new by keys alone
    assert wide == [True] + [False] * (len(wide) - 1) and len(wide) >= 2


def test_batches_of_routed_messages_are_stored_like_others(spark, tmp_path):
    for path, rows in ((tmp_path / "a", messages_of(spark, "W-1", "W-1", "W-2", " ")),
                       (tmp_path / "b", session.written(store.routed_messages(
                           messages_of(spark, "W-1", "W-1", "W-2", " ")), "messages"))):
        store.store_batch(rows, str(path), 0, "a")
        store.store_batch(rows, str(path), 1, "a")
        assert stored_refs(spark, str(path)) == ["W-1", "W-2"]
        found = {(r.batch_id, r.route, r.n) for r in spark.read.parquet(f"{path}/outcomes").collect() if r.n}
        assert found == {("0", "STORED", 2), ("0", "REPLAY", 1), ("0", "POISON", 1), ("1", "REPLAY", 3), ("1", "POISON", 1)}


def test_settings_of_a_block_are_taken_back(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), session.settings(spark, session.LONG_JOB):
        assert spark.conf.get(key) == "4m"
        1 / 0
    assert spark.conf.get(key) == before


def test_a_batch_leaves_no_shuffle_files_on_disk(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for d in disk.localDirsString() for f in pathlib.Path(d).rglob("shuffle_*.data")}

    rows, before = messages_of(spark, "W-1", "W-1", "W-2"), files()
    for batch in (0, 1):
        store.store_batch(rows, str(tmp_path / "store"), batch, "a")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before


@pytest.mark.parametrize("lines", [[None], [7], "x", {"skuId": "S"}, [{"skuId": ["S"], "quantity": True}]])
def test_lines_of_another_shape(spark, lines):
    row = parsed(spark, event(lines=lines)).first()
    if isinstance(lines, list):
        assert row.reason == "lines[0] is missing skuId or quantity" and len(row.lines) == 1
    else:
        assert row.reason is None and row.lines is None


def test_a_message_is_read_by_few_casts(spark):
    plan = plan_of(ingest.routed(parsed(spark, event())))
    assert "$.skuid" not in plan and "$.quantity" not in plan and "map<string,variant>" not in plan


def test_replay_split_parses_before_it_splits(spark):
    plan = plan_of(QUERIES["replay_split"](spark, "/root/testdata/sf0.001"))
    assert "parse_json" not in plan and "parsejson" not in plan


OFFERS = [{"skuId": "S", "amountMinor": 5, "currency": "CAD"}, {"skuId": "S", "amountMinor": 7, "currency": "SGD"}]


@pytest.mark.parametrize("value,reason", [
    (None, None), ("", "event payload is null or blank"), ("{no", "event payload is not valid JSON"),
    ("[1]", "event payload is not a JSON object"), ("3", "event payload is not a JSON object"),
    (event(orderId="DROP"), "event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem"),
    (event(audit={}), "event is missing required business key(s): orderId, externalOrderRef, audit.sourceSystem"),
    (event(lines=[{"skuId": "S", "quantity": 0, "unitPriceMinor": 1, "currency": "CAD"}]),
     "lines[0] quantity must be >= 1, got 0"),
    (event(lines=[{"skuId": "S", "quantity": "2", "unitPriceMinor": 1, "currency": "CAD"}]),
     "lines[0] is missing skuId or quantity"),
    (event(lines=[{"skuId": "S", "quantity": 2}]),
     "lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)"),
    (event(unitPrices=OFFERS, lines=[{"skuId": "S", "quantity": 2, "unitPriceMinor": None}]),
     "lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)"),
    (event(), None), (event(lines=[]), None), (event(lines="DROP"), None)])
def test_poison_reasons(spark, value, reason):
    assert parsed(spark, value).first().reason == reason


@pytest.mark.parametrize("line,want", [
    ({"quantity": 2.5, "unitPriceMinor": 12.7}, (2, 12)), ({"quantity": 2.0, "unitPriceMinor": 1e3}, (2, 1000)),
    ({"quantity": 1, "unitPriceMinor": 3_000_000_000}, (1, 3_000_000_000)),
    ({"quantity": 0.5, "unitPriceMinor": 1}, "lines[0] quantity must be >= 1, got 0"),
    ({"quantity": 3_000_000_000, "unitPriceMinor": 1}, "lines[0] is missing skuId or quantity"),
    ({"quantity": True, "unitPriceMinor": 1}, "lines[0] is missing skuId or quantity"),
    ({"quantity": 1, "unitPriceMinor": "5"}, "lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)"),
    ({"quantity": 1, "unitPriceMinor": 10 ** 20},
     "lines[0] is missing unitPriceMinor/currency (and no unitPrices fallback)")])
def test_numbers_of_order_events(spark, line, want):
    rows = parsed(spark, event(lines=[{"skuId": "S", "currency": "CAD", **line}]))
    if isinstance(want, str):
        assert rows.first().reason == want
    else:
        assert [(r.quantity, r.unit_price_minor) for r in ingest.line_rows(rows).collect()] == [want]


def test_messages_are_parsed_once(spark):
    rows = parsed(spark, event(unitPrices=OFFERS, lines=[{"skuId": "S", "quantity": 2}]))
    for frame in (ingest.line_rows(ingest.routed(rows).where("route = 'OK'")), ingest.routed(rows).groupBy("reason").count(),
                  orders.canonical_errors(rows.select("value")).where("size(errors) > 0")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"parse_?json", plan, re.IGNORECASE)) <= 2  # one expression and at most its class name
        assert "from_json" not in plan and "get_json_object" not in plan


def test_fields_that_are_not_asked_for_are_not_read(spark):
    routed = ingest.routed(parsed(spark, "{}")).groupBy("route", "reason").count()
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "$.externalOrderRef" in plan
    assert not [f for f in ("storeId", "customerRef", "reservationId", "totalAmount") if f"$.{f}" in plan]


def test_texts_that_look_like_objects_are_texts(spark):
    rows = parsed(
        spark, json.dumps({"orderId": "{o", "externalOrderRef": "[r]", "audit": {"sourceSystem": '{"a":1}'},
                           "status": {"a": 1}, "channel": [1], "region": None, "storeId": 5}),
        json.dumps({"orderId": {"a": 1}, "externalOrderRef": "R", "audit": {"sourceSystem": "W"}}))
    good = rows.where("reason is null").collect()
    assert [(r.order_id, r.external_order_ref, r.source_system, r.status, r.channel, r.region, r.store_id)
            for r in good] == [("{o", "[r]", '{"a":1}', "", "", None, "5")]
    assert rows.where("reason like '%missing required%'").count() == 1


def test_repeated_fields_take_the_last(spark):
    text = event().replace('{"', '{"orderId": "first", "', 1)
    assert parsed(spark, text).first().order_id == json.loads(event())["orderId"]


def test_last_offer_wins(spark):
    row = ingest.line_rows(parsed(spark, event(unitPrices=OFFERS, lines=[{"skuId": "S", "quantity": 2}]))).first()
    assert (row.unit_price_minor, row.currency, row.line_total_minor, row.line_no) == (7, "SGD", 14, 0)


def test_order_without_lines_is_stored(spark):
    rows = parsed(spark, event(lines=[]))
    assert ingest.order_rows(rows).count() == 1 and ingest.line_rows(rows).count() == 0


def canonical(**change):
    body = {"externalOrderRef": "W", "sourceSystem": "WEB", "storeId": "ST-CA-01", "channel": "POS",
            "lines": [{"skuId": "SKU-0001", "quantity": 1}],
            "audit": {"sourceSystem": "WEB", "receivedAt": "2026-01-01T00:00:00Z", "correlationId": "c"}}
    body.update(change)
    return json.dumps(body)


@pytest.mark.parametrize("value,errors", [
    (canonical(), []),
    (canonical(customerRef="x" * 65), ["$.customerRef: must be at most 64 characters long"]),
    (canonical(lines=[{"skuId": "SKU-0001", "quantity": 1}, {"quantity": 1.5, "x": 1}]),
     ["$.lines[1].quantity: integer expected", "$.lines[1].skuId: required", "$.lines[1].x: not allowed"]),
    (canonical(audit={"sourceSystem": "", "receivedAt": "2026-01-01", "correlationId": "c", "y": 1}),
     ["$.audit.receivedAt: date-time expected", "$.audit.sourceSystem: must be at least 1 characters long",
      "$.audit.y: not allowed"]),
    (canonical(lines=[{"skuId": "SKU-0001", "quantity": "5"}]), ["$.lines[0].quantity: integer expected"]),
    (canonical(lines=[{"skuId": "SKU-0001", "quantity": 10 ** 12}]), ["$.lines[0].quantity: must be at most 999"]),
    ("{", ["request body is not valid JSON"]), ("[]", ["$: object expected"]), ("null", ["$: object expected"]),
    (canonical(externalOrderRef=5, customerRef=7), ["$.customerRef: string expected", "$.externalOrderRef: string expected"]),
    (canonical(customerRef=None, sourceSystem={"a": 1}),
     ["$.customerRef: string expected", "$.sourceSystem: string expected"]),
    (canonical(lines={"skuId": "SKU-0001"}), ["$.lines: array expected"]),
    (canonical(lines=[3, {"skuId": 9, "quantity": 2.0}]),
     ["$.lines[0]: object expected", "$.lines[1].skuId: string expected"]),
    (canonical(lines=[{"skuId": "SKU-0001", "quantity": 0.5}]),
     ["$.lines[0].quantity: integer expected", "$.lines[0].quantity: must be at least 1"]),
    (canonical(audit="now", channel=None, storeId=None),
     ["$.audit: object expected", "$.channel: not in the enumeration", "$.storeId: string expected"])])
def test_canonical_errors(spark, value, errors):
    df = spark.createDataFrame([(value,)], "value string")
    assert orders.canonical_errors(df).first().errors == errors


def test_canonical_validation_is_compiled_and_reads_no_prices(spark):
    plan = orders.canonical_errors(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().toString()
    assert "filter(array(" not in plan and "array_sort(" not in plan  # their lambdas would have all messages interpreted
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert not any(f.endswith("/part.parquet") for f in canonical_requests(tables).inputFiles())


def test_canonical_errors_of_plain_lines(spark):
    line = {"skuId": "SKU-0001", "quantity": 1}
    texts = [canonical(lines=lines) for lines in (
        [line] * 50, [line, None], [line, {"skuId": "SKU-0001"}], [line, {"skuId": None, "quantity": 1000}],
        [line, {"skuId": "SKU-1", "quantity": 0}], [line] * 51)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    at = "$.lines[1]."
    assert [r.errors for r in orders.canonical_errors(df).sort("i").collect()] == [
        [], ["$.lines[1]: object expected"], [at + "quantity: required"],
        [at + "quantity: must be at most 999", at + "skuId: string expected"],
        [at + "quantity: must be at least 1", at + "skuId: does not match the pattern"],
        ["$.lines: must have at most 50 items"]]



def transcript(spark, rows):
    fields = ["ts", "n", "kind", "ref", "status", "time_ms", "error_code", "order_id"]
    data = [(dt.datetime(2026, 1, 1, 0, 0, r[0]), i, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp_ntz, n bigint, kind string, ref string, status int, "
                                       "time_ms double, error_code string, order_id string").select(*fields)


def test_dirty_and_clean_transcripts(spark):
    dirty = transcript(spark, [
        (0, "probe", "R-1", 201, 42.0, None, "ORD-A"), (2, "probe", "R-2", 201, 45000.0, None, "ORD-B"),
        (4, "replay", "R-1", 201, 40.0, None, "ORD-Z")])
    assert sorted(r.rule for r in transcripts.violations(dirty).collect()) == ["DUPLICATE-COMMIT", "HANG"]
    clean = transcript(spark, [
        (0, "probe", "R-1", 201, 42.0, None, "ORD-A"), (1, "probe", "R-2", 201, 88.5, None, "ORD-B"),
        (2, "probe", "R-3", 201, 120.1, None, "ORD-C"), (3, "replay", "R-1", 409, 5.0, "DUPLICATE", "ORD-A"),
        (4, "replay", "R-2", 422, 8.0, "ORD-DUP-REF", None)])
    assert transcripts.violations(clean).count() == 0
    assert {r.outcome: r.n for r in transcripts.replay_outcomes(clean).collect()} == {"ok_409": 1, "guard_422": 1}


def test_replay_after_a_failed_original_is_fine(spark):
    rows = transcript(spark, [(0, "probe", "R", 503, 1.0, None, None), (1, "replay", "R", 201, 1.0, None, "O"),
                              (2, "replay", "Q", 201, 1.0, None, "O")])
    assert [r.rule for r in transcripts.violations(rows).collect()] == ["UNPAIRED-REPLAY"]


def test_status_zero_is_allowed_inside_a_window_only(spark):
    rows = transcript(spark, [(5, "probe", "R", 0, 1.0, None, None), (20, "probe", "R", 0, 1.0, None, None)])
    window = transcripts.Window("2026-01-01 00:00:00", "2026-01-01 00:00:10")
    assert [r.n for r in transcripts.violations(rows, [window]).collect()] == [1]
    assert transcripts.recovery(rows, "2026-01-01 00:00:30").first().recovery_s is None


def test_orders_beyond_the_contract_are_parted(spark):
    heads = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "order_id string")
    rows = lambda oid, n: [(oid, i, f"SKU-{i}", 1, 5, "CAD") for i in range(n)]
    lines = spark.createDataFrame(
        rows("A", 1) + rows("B", 51) + rows("D", 50),
        "order_id string, line_no int, sku_id string, quantity int, unit_price_minor bigint, currency string")
    fits, rest = events.assemble(heads, lines)
    assert {r.order_id: [x.line_no for x in r.lines] for r in fits.collect()} == {"A": [0], "D": list(range(50))}
    assert {(r.order_id, r.line_count) for r in rest.collect()} == {("B", 51), ("C", 0)}


def test_null_headers_are_left_out(spark):
    got = spark.range(1).select(events.headers(a=F.lit("x"), b=F.lit(None).cast("string")).alias("h")).first().h
    assert [(h.key, bytes(h.value)) for h in got] == [("a", b"x")]


def test_heartbeat_grows_and_is_silent_before_the_first_record():
    now, last, sent = [0], [None], []
    beat = IdleHeartbeat(lambda: last[0], sent.append, clock_ms=lambda: now[0])
    beat.beat()
    last[0] = 1_000
    for now[0] in (9_000, 20_000, 39_000, 70_000):
        beat.onQueryIdle(None)
    assert sent == [8, 38, 69]


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["b", "c", "d", None]
    facts = [(rng.choice(keys), rng.choice([None, *range(60)] * 3), i % 400) for i in range(1500)]
    facts += [("hot", 30, 1)] * 200
    starts = {k: sorted(rng.sample(range(60), 6)) for k in ("hot", "b", "c")}
    versions = []
    for k, since in starts.items():
        for i, (a, b) in enumerate(zip(since, [*since[1:], None])):
            gap = b is not None and i % 2 == 0
            versions.append((k, None if i == 0 and k == "b" else a, b - 1 if gap else b, f"{k}{i}"))
    versions.append((None, 0, None, "of no key"))

    def plain(k, at):
        held = [v for v in versions if k is not None and at is not None and v[0] == k and (v[1] is None or v[1] <= at)]
        last = max(held, key=lambda v: -1 if v[1] is None else v[1], default=None)
        return last[3] if last and (last[2] is None or at < last[2]) else None

    found = asof.as_of_join(
        spark.createDataFrame(facts, "k string, at long, x long").repartition(5),
        spark.createDataFrame(versions, "k string, since long, until long, name string"), ("k",), "at", "since", "until")
    got = collections.Counter((r.k, r.at, r.x, r.version.name if r.version else None) for r in found.collect())
    assert got == collections.Counter((k, at, x, plain(k, at)) for k, at, x in facts)


def test_as_of_join_without_rows(spark):
    facts = spark.createDataFrame([("a", 1)], "k string, at long")
    versions = spark.createDataFrame([("a", 1, None)], "k string, since long, until long")
    assert [r.version for r in asof.as_of_join(facts, versions.where("false"), ("k",), "at", "since", "until").collect()] == [None]
    assert asof.as_of_join(facts.where("false"), versions, ("k",), "at", "since", "until").count() == 0
