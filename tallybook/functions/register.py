"""SQL names for the scalar expressions, as temporary SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallybook import fixed_values as V


def register_sql_functions(spark: SparkSession) -> list[str]:
    rules = " ".join(f"when reason rlike r'(?i){pattern}' then '{name}'" for name, pattern in V.REASON_RULES)
    spark.sql(f"""create or replace temporary function reason_category(reason string) returns string
        return case when coalesce(reason, '') = '' then 'other' {rules} else 'other' end""")
    spark.sql(r"""create or replace temporary function parse_decimal(t string) returns decimal(20,4)
        return case when regexp_replace(trim(t), r'[,$* ]', '') rlike r'^\(-?\d+(\.\d+)?\)$'
                      then -abs(try_cast(regexp_replace(trim(t), r'[,$* ()]', '') as decimal(20,4)))
                    when regexp_replace(trim(t), r'[,$* ]', '') rlike r'^-?\d+(\.\d+)?$'
                      then try_cast(regexp_replace(trim(t), r'[,$* ]', '') as decimal(20,4)) end""")
    spark.sql("""create or replace temporary function percent_change(a double, b double) returns double
        return case when a is null or b is null or a = 0 then null else floor((b - a) / a * 1000 + 0.5) / 10 end""")
    return ["reason_category", "parse_decimal", "percent_change"]
