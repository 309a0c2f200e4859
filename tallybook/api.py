"""The named lookups over one set of budget tables.  Every method returns a DataFrame (or a few) with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions.numbers import calculate
from tallybook.operators import charges as C, lookups as L, retrieval as R


class Budget:
    """tables: name to DataFrame (see schema.TABLES), plus 'events' for the hearing calendar."""

    def __init__(self, tables: dict[str, DataFrame], version: str, stop_words: list[str] | None = None):
        self.t, self.version = tables, version
        spark = next(iter(tables.values())).sparkSession
        self.stop_words = stop_words or R.english_stop_words(spark)
        self.spark = spark

    def _ask(self, words: str) -> DataFrame:
        return self.spark.createDataFrame([(1, words, words)], "query_id long, text string, typed string")

    def overview(self) -> DataFrame:
        return L.headline(self.t["section_totals"], self.version)

    def departments(self, slugs: list[str] | None = None, view: str = "stages", n: int = 5) -> DataFrame:
        rows = L.department_totals(self.t["dept_summary"], self.t["departments"], self.version)
        rows = rows.where(F.col("slug").isin(slugs)) if slugs else rows
        return rows if view == "stages" else L.movers(rows, L.diff("adopted_2026", "proposed_2027"), n)

    def calculate(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("result", calculate(F.col("op"), F.col("a"), F.col("b")))

    def department_breakdown(self, slug: str) -> DataFrame:
        return L.department_breakdown(self.t["dept_summary"], self.t["departments"], slug, self.version)

    def breakdown_with_facts(self, slug: str) -> tuple[DataFrame, DataFrame]:
        """A department's breakdown and the reviewed facts that match its name."""
        depts = L.scoped(self.t["departments"], self.version).where(F.col("slug") == slug)
        return self.department_breakdown(slug), R.facts_beside_departments(depts, L.scoped(self.t["budget_facts"], self.version), self.stop_words)

    def facts_with_sales_tax(self, words: str, line: str = "Local Sales Tax") -> tuple[DataFrame, DataFrame]:
        """Facts, and where one of them is about the sales tax the printed split of that line by fund."""
        found = self.facts(words)
        return found, R.sales_tax_beside(found, L.revenue_line_by_fund(self.t["revenues"], line, self.version))

    def search_text(self, words: str) -> tuple[DataFrame, DataFrame]:
        return (R.search_passages(self._ask(words).select("query_id", "text"), L.scoped(self.t["passages"], self.version), self.stop_words),
                self.facts(words, 3))

    def facts(self, words: str, limit: int = 4) -> DataFrame:
        return R.find_facts(self._ask(words), L.scoped(self.t["budget_facts"], self.version), self.stop_words, limit)

    def revenue_line(self, line: str) -> DataFrame:
        return L.revenue_line_by_fund(self.t["revenues"], line, self.version)

    def glossary(self, term: str) -> DataFrame:
        return R.lookup_glossary(self._ask(term).select("query_id", "typed"), L.scoped(self.t["glossary"], self.version))

    def hearings(self) -> DataFrame:
        return self.t["events"].withColumn("starts", F.to_timestamp("start")).orderBy("starts")

    def sections(self) -> DataFrame:
        return L.budget_sections(self.t["section_totals"], self.version)

    def revenues(self, fund: str = "general") -> DataFrame:
        return L.revenues_of_fund(self.t["revenues"], fund, self.version)

    def fees(self) -> DataFrame:
        return C.fee_changes(L.scoped(self.t["fees"], self.version))

    def estimate_charges(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Receipts for typed values, and the requests that cannot be used with the reason."""
        usable, rejected = C.validated_requests(requests)
        rates = C.receipt_rates(self.t["section_totals"], self.t["fees"], self.version)
        return C.with_receipt(usable.withColumn(L.VERSION, F.lit(self.version)), rates), rejected

    def position_changes(self, slug: str) -> DataFrame:
        return L.position_changes_of(self.t["position_changes"], self.t["dept_summary"], slug, self.version)

    def performance_measures(self, slug: str) -> DataFrame:
        return L.performance_measures(self.t["kpis"], self.t["departments"], slug, self.version)

    def search_lines(self, query: str, slug: str | None = None) -> DataFrame:
        tables = (self.t["line_items"], self.t["departments"], query)
        return L.search_lines(*tables, slug, self.version) if slug else L.search_lines_by_department(*tables, self.version)

    def capital_projects(self, slug: str | None = None, query: str | None = None) -> DataFrame:
        return L.capital_projects(self.t["capital_projects"], self.t["departments"], slug, query, self.version)

    def addresses(self, typed: DataFrame) -> DataFrame:
        return R.search_addresses(typed, self.t["parcels"])

    def receipts(self, view: str) -> DataFrame:
        """The charges of every parcel in one view."""
        rates = C.receipt_rates(self.t["section_totals"], self.t["fees"], self.version)
        facts = C.parcel_facts(self.t["parcels"]).withColumns({"view": F.lit(view), L.VERSION: F.lit(self.version)})
        return C.with_receipt(facts, rates)
