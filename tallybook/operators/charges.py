"""Household charges for every property in one pass: cents, rounded per line, half up.

A property meets its tariff through an equi-join on the budget version, and everything after that is a projection, so the
property table is never shuffled by the arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook import fixed_values as V
from tallybook.functions.numbers import per_share, percent_change
from tallybook.operators.lookups import VERSION, position, required, scoped

YEARS = ("2026", "2027")


def receipt_rates(section_totals: DataFrame, fees: DataFrame, version: str | None = None, total_section: str = "TOTAL",
                  components: list[tuple] | None = None) -> DataFrame:
    """One row per version: rates in hundredths of a dollar per thousand, fees in cents, each with its citation.
    A missing rate or fee stops the job."""
    components = components or V.TAX_COMPONENTS
    levy = scoped(section_totals, version).where(F.col("line") == "levy")
    picks = []
    for name, section in [("total", total_section)] + [(f"part_{s}", s) for s, _ in components]:
        pick = F.min_by(F.struct("tax_rate_2026", "tax_rate_2027", "cite"),
                        F.when(F.col("section") == section, position()))
        picks.append(_hundredths(pick, "tax_rate_2026", "tax_rate_2027", f"tax rate of section {section}").alias(name))
    rates = levy.groupBy(VERSION).agg(*picks)
    fee_picks = [_hundredths(F.min_by(F.struct("value_2026", "value_2027", "cite"), F.when(F.col("fee") == k, position())),
                             "value_2026", "value_2027", f"fee {k}").alias(k) for k in V.FEE_KEYS]
    return rates.join(scoped(fees, version).groupBy(VERSION).agg(*fee_picks), VERSION)


def _hundredths(pick: Column, a: str, b: str, what: str) -> Column:
    both = [F.floor(required(pick[c], what) * 100 + F.lit(0.5).cast("decimal(3,2)")).cast("long").alias(f"r{y}")
            for c, y in ((a, "2026"), (b, "2027"))]
    return F.struct(*both, pick["cite"].alias("cite"))


def parcel_facts(parcels: DataFrame) -> DataFrame:
    """What the calculator needs of a parcel.  City garbage service: class 1 with one to four dwellings, an assumption."""
    units = F.coalesce("nr_units", F.lit(0))
    rest = [c for c in parcels.columns if c not in ("c_a_total", "p_a_total", "nr_units", "c_a_class", "own_ocpd")]
    return parcels.select(
        *rest, F.coalesce("c_a_total", F.lit(0)).cast("long").alias("assessed_2026"),
        F.coalesce("p_a_total", F.lit(0)).cast("long").alias("assessed_2025"), units.cast("long").alias("units"),
        F.col("c_a_class").alias("assessment_class"),
        (F.coalesce(F.col("c_a_class") == "1", F.lit(False)) & units.between(1, 4)).alias("city_garbage"),
        F.coalesce(F.col("own_ocpd") == "O", F.lit(False)).alias("owner_occupied"))


def validated_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed requests (text columns) split into usable inputs and rejects with the first reason that applies."""
    def whole(name: str) -> Column:
        return F.when(F.trim(F.col(name)).rlike(r"^-?\d+$"), F.col(name).try_cast("long"))

    def outside(name: str, low: int, high: int, optional: bool = True) -> Column:
        bad = ~F.coalesce(whole(name).between(low, high), F.lit(False))
        return F.col(name).isNotNull() & bad if optional else bad

    by_key = F.col("taxkey").isNotNull()
    reason = (F.when(~F.coalesce(F.col("view").isin(V.VIEWS), F.lit(False)), "view is none of owner, renter, landlord")
              .when(outside("frontage_ft", 1, 2000), "frontage_ft is no whole number from 1 to 2000")
              .when(outside("extra_carts", 0, 10), "extra_carts is no whole number from 0 to 10")
              .when(by_key & ~F.col("taxkey").rlike(r"^\d{10}$"), "taxkey has not ten digits")
              .when(~by_key & outside("assessed_2026", 1, 1_000_000_000, optional=False),
                    "no taxkey, and assessed_2026 is not in whole dollars")
              .when(~by_key & (outside("assessed_2025", 1, 1_000_000_000) | outside("units", 1, 999)
                               | outside("building_units", 1, 5000)),
                    "assessed_2025, units or building_units is out of range"))
    judged = requests.withColumn("error", reason)
    units = F.coalesce(whole("units"), F.lit(1))
    usable = judged.where("error is null").withColumns({
        "frontage_ft": whole("frontage_ft"), "extra_carts": F.coalesce(whole("extra_carts"), F.lit(0)),
        "assessed_2025": F.coalesce(whole("assessed_2025"), whole("assessed_2026")),
        "assessed_2026": whole("assessed_2026"), "units": units,
        "building_units": F.coalesce(whole("building_units"), units),
        # A flat in a big building: the building's size decides the city's garbage service.
        "city_garbage": F.coalesce(whole("building_units"), units) <= 4,
        "assessment_class": F.lit(None).cast("string")}).drop("error")
    return usable, judged.where("error is not null")


def eligibility(inputs: DataFrame) -> DataFrame:
    """inputs: assessed_2026, assessed_2025, units, city_garbage, assessment_class, view."""
    kind = (F.when(F.col("assessment_class") == "9", "exempt").when(F.col("assessment_class") == "3", "state_assessed")
            .when(~F.coalesce(F.col("assessed_2026") > 0, F.lit(False)), "no_assessment")
            .when((F.col("view") == "renter") & (F.col("units") == 0), "no_dwellings").otherwise("estimate"))
    return inputs.withColumn("kind", kind)


def _tax(assessed: str, rate: Column) -> Column:
    """assessed dollars times hundredths per thousand, in cents."""
    return F.floor((F.lit(2) * F.col(assessed) * rate + 1000) / F.lit(2000)).cast("long")


def _both(rate: Column, cents_of) -> list[Column]:
    return [cents_of(rate[f"r{y}"], y).alias(f"c{y}") for y in YEARS]


def with_receipt(inputs: DataFrame, rates: DataFrame, components: list[tuple] | None = None) -> DataFrame:
    """Each eligible input with its charge lines, tax split, totals and the assumptions made, as arrays and columns.
    The tariff is one row per version; Spark broadcasts it by its size."""
    components = components or V.TAX_COMPONENTS
    for name, default in (("frontage_ft", F.lit(None).cast("long")), ("extra_carts", F.lit(0))):
        if name not in inputs.columns:
            inputs = inputs.withColumn(name, default)
    rows = eligibility(inputs).where("kind = 'estimate'").join(rates, VERSION)
    share = F.when(F.col("view") == "renter", F.greatest(F.col("units"), F.lit(1))).otherwise(F.lit(1)).cast("long")
    frontage = F.coalesce("frontage_ft", F.lit(V.DEFAULT_FRONTAGE_FT)).cast("long")
    year_value = {"2026": "assessed_2025", "2027": "assessed_2026"}

    def taxed(rate: Column) -> list[Column]:
        return _both(rate, lambda r, y: per_share(_tax(year_value[y], r), share))

    def fee(key: str, qty: Column) -> list[Column]:
        return _both(F.col(key), lambda r, y: per_share(r * qty, share))

    def line(ordinal: int, key: str, label: Column, amounts: list[Column], cite: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(ordinal).alias("ordinal"), F.lit(key).alias("key"), label.alias("label"),
                                     *amounts, cite.alias("cite")))

    owner, garbage, always = F.col("view") == "owner", F.col("city_garbage"), F.lit(True)
    feet = F.concat(F.lit(" ("), frontage.cast("string"), F.lit(" ft)"))
    both_feet = [(per_share(F.col("snow_ice")[f"r{y}"] * frontage, share)
                  + per_share(F.col("street_lighting")[f"r{y}"] * frontage, share)).alias(f"c{y}") for y in YEARS]
    lines = F.array_compact(F.array(
        line(1, "property_tax", F.lit("City property tax"), taxed(F.col("total")), F.col("total.cite"), always),
        line(2, "solid_waste", F.lit("Solid waste fee"), fee("solid_waste", F.greatest(F.col("units"), F.lit(1))),
             F.col("solid_waste.cite"), garbage),
        line(3, "extra_carts", F.lit("Extra garbage carts"), fee("extra_cart", F.col("extra_carts")),
             F.col("extra_cart.cite"), garbage & (F.col("extra_carts") > 0)),
        line(4, "snow_ice", F.concat(F.lit("Snow & ice"), feet), fee("snow_ice", frontage), F.col("snow_ice.cite"), owner),
        line(5, "street_lighting", F.concat(F.lit("Street lighting"), feet), fee("street_lighting", frontage),
             F.col("street_lighting.cite"), owner),
        line(6, "frontage", F.concat(F.lit("Snow & ice and lighting"), feet), both_feet, F.col("snow_ice.cite"), ~owner),
        line(7, "sewer_stormwater", F.lit("Sewer + stormwater"), fee("sewer_stormwater_avg", F.col("units")),
             F.col("sewer_stormwater_avg.cite"), F.col("units") > 0)))
    split = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f"split_{s}").alias("key"), F.lit(s).alias("section"),
                               F.lit(label).alias("label"), *taxed(F.col(f"part_{s}")), F.col(f"part_{s}.cite").alias("cite"))
                      for i, (s, label) in enumerate(components, 1)])

    def add(items: Column, year: str) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x[f"c{year}"])

    assumed = F.array_compact(F.array(F.when(F.col("frontage_ft").isNull(), F.lit("frontage_40ft")),
                                      F.when(garbage, F.lit("city_garbage_assumed"))))
    out = rows.withColumns({"lines": lines, "split": split, "defaults": assumed,
                            "paid_by": F.when(owner, "you").otherwise("owner")})
    out = out.withColumns({"total_c2026": add(F.col("lines"), "2026"), "total_c2027": add(F.col("lines"), "2027"),
                           "split_remainder_c2027": F.get("lines", F.lit(0))["c2027"] - add(F.col("split"), "2027")})
    twelve = F.lit(12).cast("long")
    out = out.withColumns({"month_c2026": per_share(F.col("total_c2026"), twelve),
                           "month_c2027": per_share(F.col("total_c2027"), twelve)})
    return out.select(*inputs.columns, "kind", "paid_by", "lines", "split", "split_remainder_c2027", "total_c2026",
                      "total_c2027", "month_c2026", "month_c2027", "defaults")


def receipt_lines(receipts: DataFrame, keys: list[str], items: str = "lines") -> DataFrame:
    """One row per input and charge line (items='lines') or tax part (items='split')."""
    return receipts.select(*keys, F.inline(items))


def receipt_changes(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """The receipt in dollars with every change worked out: year, month, tax, services, assessment percent."""
    dollars = lambda c: c.cast("decimal(18,2)") / 100
    year_change = F.col("total_c2027") - F.col("total_c2026")
    tax = F.get("lines", F.lit(0))
    tax_change = tax["c2027"] - tax["c2026"]
    month = F.floor((year_change.cast("double") / 12) + 0.5)
    return receipts.select(
        *keys, dollars(F.col("total_c2026")).alias("dollars_2026"), dollars(F.col("total_c2027")).alias("dollars_2027"),
        dollars(year_change).alias("change_per_year"), dollars(month).alias("change_per_month"),
        dollars(F.col("month_c2026")).alias("month_dollars_2026"), dollars(F.col("month_c2027")).alias("month_dollars_2027"),
        dollars(tax_change).alias("property_tax_change"), dollars(year_change - tax_change).alias("service_charges_change"),
        percent_change(F.col("assessed_2026") - F.col("assessed_2025"), F.col("assessed_2025")).alias(
            "assessment_change_percent"))


def fee_changes(fees: DataFrame, frontage_ft: int = V.DEFAULT_FRONTAGE_FT) -> DataFrame:
    """Each fee with its change; a per-foot fee also with its cost on a typical frontage."""
    per_foot = F.col("fee").isin(V.PER_FOOT_FEES)
    change = F.col("value_2027") - F.col("value_2026")
    typical = lambda c: F.when(per_foot, (c * frontage_ft).cast("decimal(14,2)"))
    return fees.select(
        VERSION, "fee", "value_2026", "value_2027", change.alias("change"),
        percent_change(change, F.col("value_2026")).alias("percent_change"),
        typical(F.col("value_2026")).alias("typical_2026"), typical(F.col("value_2027")).alias("typical_2027"),
        typical(change).alias("typical_change"), *[c for c in ("cite",) if c in fees.columns])


def charge_distribution(receipts: DataFrame, keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """How yearly charges spread over all properties."""
    return receipts.groupBy(*keys).agg(
        F.count("*").alias("properties"), F.sum("total_c2026").alias("total_c2026"), F.sum("total_c2027").alias("total_c2027"),
        F.count_if(F.col("total_c2027") > F.col("total_c2026")).alias("rises"),
        F.percentile_approx("total_c2027", [0.1, 0.5, 0.9], accuracy).alias("deciles_c2027"))
