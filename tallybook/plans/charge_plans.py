"""Household charges for every customer seen as a property, under a tariff taken from the line-item table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallybook.operators import charges as C
from tallybook.plans import bindings as B
from tallybook.plans.registry import query

# Worked-example tariff: printed rates per $1,000 and fees, 2026 and 2027.
RATES = {"TOTAL": ("7.61", "7.29"), "A": ("3.33", "3.05"), "D": ("2.41", "2.31"), "B": ("1.74", "1.80"),
         "F": ("0.11", "0.11"), "C": ("0.02", "0.02")}
FEES = {"solid_waste": ("271.80", "280.00"), "extra_cart": ("81.24", "83.68"), "snow_ice": ("1.19", "1.23"),
        "street_lighting": ("1.12", "1.16"), "sewer_stormwater_avg": ("241.88", "247.02")}


def tariff(spark):
    """section_totals and fees rows of the worked example."""
    st = [("P", s, "levy", a, b) for s, (a, b) in RATES.items()]
    fees = [("P", k, a, b) for k, (a, b) in FEES.items()]
    cite = B.cite("summary", F.lit(17), F.lit(1))
    st = spark.createDataFrame(st, "budget_version string, section string, line string, a string, b string").select(
        "budget_version", "section", "line", F.col("a").cast("decimal(8,2)").alias("tax_rate_2026"),
        F.col("b").cast("decimal(8,2)").alias("tax_rate_2027"), cite)
    fees = spark.createDataFrame(fees, "budget_version string, fee string, a string, b string").select(
        "budget_version", "fee", F.col("a").cast("decimal(12,2)").alias("value_2026"),
        F.col("b").cast("decimal(12,2)").alias("value_2027"), cite)
    return st, fees


def inputs(spark, sf):
    """Every parcel seen by its owner, by a renter, and by a landlord with two extra carts and 55 feet of frontage."""
    facts = C.parcel_facts(B.parcels(spark, sf))
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(f).cast("long").alias("frontage_ft"), F.lit(x).alias("extra_carts"))
                      for v, f, x in (("owner", None, 0), ("renter", None, 0), ("landlord", 55, 2))])
    return facts.select("*", F.inline(views))


def receipts(spark, sf):
    return C.with_receipt(inputs(spark, sf), C.receipt_rates(*tariff(spark)))


KEYS = ["taxkey", "view"]
HALF_UP = "cast(floor((2 * ({0}) + ({1})) / (2.0 * ({1}))) as bigint)"


def share_of(cents: str) -> str:
    return f"((2 * ({cents}) + share) // (2 * share))"


def tax(assessed: str, rate: int) -> str:
    return share_of(f"((2 * {assessed} * {rate} + 1000) // 2000)")


INPUT_SQL = """p as (
  select lpad(c_custkey::varchar, 10, '0') as taxkey,
    case c_mktsegment when 'AUTOMOBILE' then '1' when 'HOUSEHOLD' then '1' when 'BUILDING' then '2' when 'FURNITURE' then '3'
      else '9' end as class,
    case when c_acctbal > 0 then cast(floor(c_acctbal * 100 + 0.5) as bigint) end as cur, c_custkey % 7 as units
  from customer),
f as (select taxkey, class, coalesce(cur, 0) as a26, coalesce(cast(floor(cur * 94 // 100) as bigint), 0) as a25, units,
    class = '1' and units between 1 and 4 as garbage from p),
i as (select *, case when class = '9' then 'exempt' when class = '3' then 'state_assessed' when a26 <= 0 then 'no_assessment'
      when view = 'renter' and units = 0 then 'no_dwellings' else 'estimate' end as kind,
    case when view = 'renter' then greatest(units, 1) else 1 end as share
  from f, (values ('owner', 40, 0), ('renter', 40, 0), ('landlord', 55, 2)) v(view, ft, carts))"""


def _hundredths(text: str) -> int:
    return int(text.replace(".", ""))


def _line_sql() -> str:
    parts = []

    def add(ordinal, key, cond, a, b):
        parts.append(f"select taxkey, view, {ordinal} as ordinal, '{key}' as key, {a} as c2026, {b} as c2027 "
                     f"from i where kind = 'estimate' and {cond}")

    r = [_hundredths(x) for x in RATES["TOTAL"]]
    add(1, "property_tax", "true", tax("a25", r[0]), tax("a26", r[1]))
    fee = {k: [_hundredths(x) for x in v] for k, v in FEES.items()}

    def both(key, qty):
        return [share_of(f"{c} * {qty}") for c in fee[key]]

    add(2, "solid_waste", "garbage", *both("solid_waste", "greatest(units, 1)"))
    add(3, "extra_carts", "garbage and carts > 0", *both("extra_cart", "carts"))
    add(4, "snow_ice", "view = 'owner'", *both("snow_ice", "ft"))
    add(5, "street_lighting", "view = 'owner'", *both("street_lighting", "ft"))
    add(6, "frontage", "view <> 'owner'",
        *[f"{s} + {l}" for s, l in zip(both("snow_ice", "ft"), both("street_lighting", "ft"))])
    add(7, "sewer_stormwater", "units > 0", *both("sewer_stormwater_avg", "units"))
    return " union all ".join(parts)


def _split_sql() -> str:
    parts = []
    for n, (s, _) in enumerate(C.V.TAX_COMPONENTS, 1):
        a, b = (_hundredths(x) for x in RATES[s])
        parts.append(f"select taxkey, view, {n} as ordinal, '{s}' as section, {tax('a25', a)} as c2026, "
                     f"{tax('a26', b)} as c2027 from i where kind = 'estimate'")
    return " union all ".join(parts)


LINES = f"with {INPUT_SQL}, l as ({_line_sql()})"
LONGS = "cast(c2026 as bigint) as c2026, cast(c2027 as bigint) as c2027"


@query("charges_lines", f"{LINES} select taxkey, view, cast(ordinal as integer) as ordinal, key, {LONGS} from l")
def charges_lines(spark, sf):
    return C.receipt_lines(receipts(spark, sf), KEYS).drop("label", "cite")


@query("charges_split", f"with {INPUT_SQL}, l as ({_split_sql()}) "
                        f"select taxkey, view, cast(ordinal as integer) as ordinal, section, {LONGS} from l")
def charges_split(spark, sf):
    return C.receipt_lines(receipts(spark, sf), KEYS, "split").drop("key", "label", "cite")


@query("charges_totals", f"""{LINES}, s as ({_split_sql()}),
t as (select taxkey, view, cast(sum(c2026) as bigint) as t26, cast(sum(c2027) as bigint) as t27,
    cast(sum(case when key = 'property_tax' then c2027 end) as bigint) as tax from l group by all),
sp as (select taxkey, view, cast(sum(c2027) as bigint) as parts from s group by all)
select t.taxkey, t.view, case when t.view = 'owner' then 'you' else 'owner' end as paid_by, t26 as total_c2026, t27 as total_c2027,
  cast((2 * t26 + 12) // 24 as bigint) as month_c2026, cast((2 * t27 + 12) // 24 as bigint) as month_c2027,
  tax - parts as split_remainder_c2027,
  concat_ws(',', case when t.view <> 'landlord' then 'frontage_40ft' end, case when garbage then 'city_garbage_assumed' end) as defaults
from t join sp on t.taxkey = sp.taxkey and t.view = sp.view join i on i.taxkey = t.taxkey and i.view = t.view""")
def charges_totals(spark, sf):
    return receipts(spark, sf).select(
        *KEYS, "paid_by", "total_c2026", "total_c2027", "month_c2026", "month_c2027", "split_remainder_c2027",
        F.concat_ws(",", "defaults").alias("defaults"))


@query("charges_in_dollars", f"""{LINES}, t as (select l.taxkey, l.view, sum(c2026) as t26, sum(c2027) as t27,
    sum(case when key = 'property_tax' then c2027 - c2026 end) as taxd from l group by all)
select t.taxkey, t.view, t26 / 100.0 as dollars_2026, t27 / 100.0 as dollars_2027, (t27 - t26) / 100.0 as change_per_year,
  floor(cast(t27 - t26 as double) / 12 + 0.5) / 100 as change_per_month, taxd / 100.0 as property_tax_change,
  (t27 - t26 - taxd) / 100.0 as service_charges_change,
  case when a25 <> 0 then floor(cast(a26 - a25 as double) / cast(a25 as double) * 1000 + 0.5) / 10 end as assessment_change_percent
from t join i on i.taxkey = t.taxkey and i.view = t.view""")
def charges_in_dollars(spark, sf):
    out = C.receipt_changes(receipts(spark, sf), KEYS).drop("month_dollars_2026", "month_dollars_2027")
    return out.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in out.columns if c not in KEYS])


@query("charge_eligibility", f"with {INPUT_SQL} select view, kind, count(*) as n from i group by all")
def charge_eligibility(spark, sf):
    return C.eligibility(inputs(spark, sf)).groupBy("view", "kind").agg(F.count("*").alias("n"))


@query("parcel_facts", f"with {INPUT_SQL} select distinct taxkey, a26 as assessed_2026, a25 as assessed_2025, "
                       "cast(units as bigint) as units, garbage as city_garbage, class as assessment_class from i")
def parcel_facts(spark, sf):
    return C.parcel_facts(B.parcels(spark, sf)).select(
        "taxkey", "assessed_2026", "assessed_2025", "units", "city_garbage", "assessment_class")


@query("charge_distribution", f"""{LINES}, t as (select taxkey, view, sum(c2026) as t26, sum(c2027) as t27 from l group by all)
select view, count(*) as properties, cast(sum(t26) as bigint) as total_c2026, cast(sum(t27) as bigint) as total_c2027,
  cast(count_if(t27 > t26) as bigint) as rises from t group by view""")
def charge_distribution(spark, sf):
    return C.charge_distribution(receipts(spark, sf), ["view"]).drop("deciles_c2027")


@query("charge_requests", """with r as (
  select c_custkey, case when c_mktsegment = 'BUILDING' then 'tenant' when c_mktsegment = 'MACHINERY' then 'renter' else 'owner' end as view,
    case when c_nationkey > 20 then 0 else c_nationkey end as ft, c_custkey % 13 as carts,
    case when c_mktsegment = 'AUTOMOBILE' then lpad(c_custkey::varchar, case when c_nationkey % 2 = 0 then 10 else 9 end, '0') end as taxkey,
    cast(floor(c_acctbal) as bigint) as a26, c_nationkey * 50 as units from customer)
select c_custkey, case
  when view = 'tenant' then 'view is none of owner, renter, landlord'
  when ft not between 1 and 2000 then 'frontage_ft is no whole number from 1 to 2000'
  when carts not between 0 and 10 then 'extra_carts is no whole number from 0 to 10'
  when taxkey is not null and length(taxkey) <> 10 then 'taxkey has not ten digits'
  when taxkey is null and a26 not between 1 and 1000000000 then 'no taxkey, and assessed_2026 is not in whole dollars'
  when taxkey is null and units not between 1 and 999 then 'assessed_2025, units or building_units is out of range'
  else 'ok' end as outcome from r""")
def charge_requests(spark, sf):
    """Typed requests, one per customer: valid inputs and rejects with their reason (the whole request table)."""
    c = B.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    typed = c.select(
        "c_custkey", F.when(seg == "BUILDING", "tenant").when(seg == "MACHINERY", "renter").otherwise("owner").alias("view"),
        F.when(F.col("c_nationkey") > 20, 0).otherwise(F.col("c_nationkey")).cast("string").alias("frontage_ft"),
        (F.col("c_custkey") % 13).cast("string").alias("extra_carts"),
        F.when(seg == "AUTOMOBILE", F.when(F.col("c_nationkey") % 2 == 0, F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
               .otherwise(F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("taxkey"),
        F.floor("c_acctbal").cast("string").alias("assessed_2026"), F.lit(None).cast("string").alias("assessed_2025"),
        (F.col("c_nationkey") * 50).cast("string").alias("units"), F.lit(None).cast("string").alias("building_units"))
    usable, rejected = C.validated_requests(typed)
    parts = [usable.select("c_custkey", F.lit("ok").alias("outcome")), rejected.select("c_custkey", F.col("error").alias("outcome"))]
    return reduce(DataFrame.unionByName, parts)


FEE_SQL = """f as (select p_brand as fee, min(cast(floor(p_retailprice * 100 + 0.5) as bigint)) as a,
    max(cast(floor(p_retailprice * 100 + 0.5) as bigint)) as b from part group by p_brand)"""


@query("fee_changes", f"""with {FEE_SQL} select fee, a / 100.0 as value_2026, b / 100.0 as value_2027, (b - a) / 100.0 as change,
  floor(cast(b - a as double) / cast(a as double) * 1000 + 0.5) / 10 as percent_change,
  case when fee = 'Brand#1' then a * 40 / 100.0 end as typical_2026, case when fee = 'Brand#1' then b * 40 / 100.0 end as typical_2027,
  case when fee = 'Brand#1' then (b - a) * 40 / 100.0 end as typical_change
from (select case when fee = 'snow_ice' then 'Brand#1' else fee end as fee, a, b from f)""")
def fee_changes(spark, sf):
    """Fees are brands: the lowest and highest price of a brand as the fee of the two years; one brand is charged by foot."""
    p = B.table(spark, sf, "part").groupBy("p_brand").agg(
        F.min(B.cents("p_retailprice")).alias("a"), F.max(B.cents("p_retailprice")).alias("b"))
    fees = p.select(F.lit("P").alias("budget_version"),
                    F.when(F.col("p_brand") == "Brand#1", "snow_ice").otherwise(F.col("p_brand")).alias("fee"),
                    (F.col("a") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").alias("value_2026"),
                    (F.col("b") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").alias("value_2027"))
    out = C.fee_changes(fees).withColumn("fee", F.when(F.col("fee") == "snow_ice", "Brand#1").otherwise(F.col("fee")))
    return out.select("fee", *[F.col(c).cast("double").alias(c) for c in out.columns if c not in ("fee", "budget_version")])
