import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, masking, money, outcomes, regions, text

MS = lambda s: int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("n,digest", [
    (3, "16cfb048c4df"), (7, "4379dd03795d"), (11, "8688b926b7c8"), (15, "921612995fb0"), (19, "fbb8e58197a7"),
    (23, "e81a771c9906"), (27, "b048ec253889")])
def test_mask_vectors(value, n, digest):
    assert value(masking.mask_customer_ref(F.lit(f"cust-cn-{n}"), F.lit("CN"), "sim-egress-secret")) == f"msk-{digest}"


@pytest.mark.parametrize("ref,region", [("cust-ca-1", "CA"), ("", "CN"), ("  ", "CN"), (None, "CN"), ("x", None)])
def test_mask_leaves_the_rest(value, ref, region):
    assert value(masking.mask_customer_ref(F.lit(ref).cast("string"), F.lit(region).cast("string"), "s")) == ref


def test_long_secret_is_hashed_first(value):
    import hashlib
    import hmac

    secret = b"k" * 100
    want = hmac.new(secret, "cust-cn-1".encode(), hashlib.sha256).hexdigest()
    assert value(masking.hmac_sha256_hex(F.lit("cust-cn-1"), secret)) == want


@pytest.mark.parametrize("cad,currency,want", [
    (12999, "SGD", 12739), (500, "SGD", 490), (500, "CNY", 2565), (513, "CNY", 2632), (25, "SGD", 25), (7, "CAD", 7)])
def test_price_conversion(value, cad, currency, want):
    assert value(money.convert_from_cad(F.lit(cad), F.lit(currency))) == want


@pytest.mark.parametrize("q,p,want", [(2, 12500, 25000), (3, 3333, 9999), (999, 300300, 299999700),
                                      (2_000_000_000, 9_000_000_000_000_000, None)])
def test_line_total(value, q, p, want):
    assert value(money.line_total(F.lit(q), F.lit(p))) == want


@pytest.mark.parametrize("now,want", [("2026-09-13T20:00:00", "2026-09-13"), ("2026-09-13T00:30:00", "2026-09-12"),
                                      ("2026-09-12T16:00:00", "2026-09-12")])
def test_business_date(value, now, want):
    assert str(value(dates.business_date(F.lit(MS(now))))) == want
    stamp = dt.datetime.fromisoformat(now).replace(tzinfo=dt.timezone.utc)
    assert str(dates.default_business_date(stamp)) == want


@pytest.mark.parametrize("sgt,want", [("05:59:00", True), ("06:00:00", True), ("06:00:01", False),
                                      ("06:00:00.001", False)])
def test_window(value, sgt, want):
    done = MS(f"2026-09-13T{sgt}") - 8 * 3_600_000
    assert value(dates.within_window(F.lit(done))) is want


def test_window_looks_at_the_time_of_day_only(value):
    late = F.lit(MS("2026-09-14T16:30:00"))  # 00:30 two Singapore days later
    day = F.lit("2026-09-13").cast("date")
    assert value(dates.within_window(late)) is True
    assert value(dates.within_window_strict(late, day)) is False


@pytest.mark.parametrize("now,want", [(5000, 4), (999, 0), (0, 0)])
def test_freshness(value, now, want):
    assert value(dates.freshness_seconds(F.lit(1000).cast("bigint"), F.lit(now).cast("bigint"))) == want


@pytest.mark.parametrize("ms,want", [(MS("2026-09-12T23:59:59.999"), "20260912"), (0, "19700101"), (-1, "19691231")])
def test_dt(value, ms, want):
    assert value(dates.dt_utc(F.lit(ms).cast("bigint"))) == want


@pytest.mark.parametrize("bad", ["2026-9-1", "20260901", "2026-13-01", "", "2026-02-30"])
def test_strict_date(bad):
    with pytest.raises(ValueError):
        dates.parse_business_date(bad)


@pytest.mark.parametrize("store,want", [("ST-CA-01", "CA"), ("st-cn-02", "CN"), ("ST-SG-99", "SG"), ("ST-XX-01", None),
                                        ("ST-CA-1", None), ("XX-CA-01", None), (None, None)])
def test_region_of_store(value, store, want):
    assert value(regions.region_of_store(F.lit(store).cast("string"))) == want


def test_text_functions(value):
    assert value(text.truncate(F.lit("abcdefgh"), 6)) == "abc..."
    assert value(text.truncate(F.lit("abcdef"), 6)) == "abcdef"
    assert value(text.bar_key(F.lit("ORD-1"), F.lit(None).cast("int"))) == "ORD-1|null"
    assert value(text.first_non_blank(F.lit("  "), F.lit("d"))) == "d"
    assert value(text.first_non_blank(F.lit(" k "), F.lit("d"))) == "k"


def test_row_json_sorts_keys_and_keeps_nulls(spark):
    df = spark.sql("select 1 as b, cast(null as string) as a")
    assert df.select(text.row_json(df)).first()[0] == '{"a":null,"b":1}'


def test_outcome_classes(value):
    got = [value(outcomes.outcome_class(F.lit(s))) for s in (201, 400, 409, 422, 500, 503, 0, 418)]
    assert got == ["SUCCESS", "SENDER", "SENDER", "BUSINESS", "RECEIVER", "RECEIVER", "NETWORK", "OTHER"]
    assert value(outcomes.fault_class(F.lit("INV-OUT-OF-STOCK"))) == "BUSINESS"
    assert value(outcomes.fault_class(F.lit("UPSTREAM-UNAVAILABLE"))) == "INFRA"
    assert value(outcomes.fault_subsystem(F.lit("PRC-SKU-UNKNOWN"))) == "PRICING"
