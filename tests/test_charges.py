from __future__ import annotations

import pytest

from tallybook.operators import charges as C
from tallybook.plans.charge_plans import tariff

COLUMNS = ("id string, budget_version string, assessed_2026 long, assessed_2025 long, units long, city_garbage boolean, "
           "assessment_class string, view string, frontage_ft long, extra_carts int")


def run(spark, *rows):
    return C.with_receipt(spark.createDataFrame([("x", "P", *r) for r in rows], COLUMNS), C.receipt_rates(*tariff(spark)))


def test_owner_example(spark):
    r = run(spark, (200_000, 188_000, 1, True, None, "owner", 40, 0)).first()
    lines = {x["key"]: (x["c2026"], x["c2027"]) for x in r["lines"]}
    assert lines["property_tax"] == (143068, 145800)
    assert [lines[k][1] for k in ("solid_waste", "snow_ice", "street_lighting", "sewer_stormwater")] == [28000, 4920, 4640, 24702]
    assert [s["c2027"] for s in r["split"]] == [61000, 46200, 36000, 2200, 400]
    assert (r["total_c2026"], r["total_c2027"]) == (203676, 208062)
    assert "frontage_40ft" not in r["defaults"]


def test_renter_example(spark):
    r = run(spark, (320_000, 305_000, 4, True, None, "renter", 40, 0)).first()
    lines = {x["key"]: (x["c2026"], x["c2027"]) for x in r["lines"]}
    assert lines["property_tax"] == (58026, 58320) and lines["frontage"] == (2310, 2390)
    assert (r["total_c2026"], r["total_c2027"], r["month_c2026"], r["month_c2027"]) == (111704, 113412, 9309, 9451)
    assert r["paid_by"] == "owner"


def test_half_cent_rounds_up(spark):
    r = run(spark, (150_000, 150_000, 4, False, None, "renter", 40, 0)).first()
    assert r["lines"][0]["c2027"] == 27338 and "solid_waste" not in {x["key"] for x in r["lines"]}


def test_defaults_are_named(spark):
    assert run(spark, (200_000, 188_000, 1, True, None, "owner", None, 0)).first()["defaults"] == ["frontage_40ft", "city_garbage_assumed"]


def test_not_eligible(spark):
    rows = [(0, 0, 0, False, "9", "owner", None, 0), (0, 0, 0, False, "3", "owner", None, 0), (0, 0, 1, False, "1", "owner", None, 0),
            (7800, 7800, 0, False, None, "renter", None, 0)]
    df = spark.createDataFrame([(str(i), "P", *r) for i, r in enumerate(rows)], COLUMNS)
    assert [r["kind"] for r in C.eligibility(df).orderBy("id").collect()] == ["exempt", "state_assessed", "no_assessment", "no_dwellings"]


def test_fee_changes(spark):
    got = {r["fee"]: r for r in C.fee_changes(tariff(spark)[1]).collect()}
    assert (float(got["solid_waste"]["change"]), got["solid_waste"]["percent_change"]) == (8.2, 3.0)
    assert (float(got["snow_ice"]["typical_2026"]), float(got["snow_ice"]["typical_2027"])) == (47.6, 49.2)


def test_missing_fee_stops_the_job(spark):
    st, fees = tariff(spark)
    with pytest.raises(Exception, match="extra_cart"):
        C.receipt_rates(st, fees.where("fee <> 'extra_cart'")).collect()
