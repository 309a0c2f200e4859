"""Caches, keys, versioned loads and request rules over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallybook.session import checkpoint_root
from tallybook.operators.checks import orphans
from tallybook.plans import bindings as B
from tallybook.plans.lookup_plans import DEPT_SUMMARY
from tallybook.plans.registry import query, table
from tallybook.sources import cache as C, tables as T, versions as S
from tallybook.streaming import requests as R

LIMIT, WINDOW = 2, 24 * 3600


@query("cache_misses", """with d as (select sha256('m|document|' || source || chr(10) || chr(10) || text) as hash, lang from documents)
select hash, count(*) as rows from d where hash not in (select hash from d where lang in ('en', 'fr')) group by hash""")
def cache_misses(spark, sf):
    """Texts whose vector is not cached; the cache holds those of the English and French documents."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("context_header"), "text", "lang")
    items = C.keyed_texts(d, None, "m")
    cached = C.keyed_texts(d.where(F.col("lang").isin("en", "fr")), None, "m").select("hash").distinct()
    missing = C.cache_misses(items, cached)
    return items.join(missing.select("hash"), "hash").groupBy("hash").agg(F.count("*").alias("rows"))


@query("cache_refill", """with d as (select doc_id, sha256('m|document|' || source || chr(10) || chr(10) || text) as hash, lang from documents),
c as (select hash, min(doc_id) as v from d where lang in ('en', 'fr') group by hash)
select doc_id::varchar as id, v as embedding from d left join c using (hash)""")
def cache_refill(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("context_header"), "text", "lang")
    items = C.keyed_texts(d, None, "m")
    known = C.keyed_texts(d.where(F.col("lang").isin("en", "fr")), None, "m")
    cache = known.groupBy("hash").agg(F.min(F.col("id").cast("long")).alias("embedding"))
    return C.refill(items, cache).select("id", "embedding")


@query("line_keys", """with l as (select l_orderkey, l_linenumber, max(l_partkey) as k from lineitem group by all)
select o_orderkey as l_orderkey, cast(o_custkey % 7 + 1 as integer) as l_linenumber, k as line_item_id from orders left join l on l_orderkey = o_orderkey and l_linenumber = o_custkey % 7 + 1""")
def line_keys(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("line_item_id"))
    pos = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return T.with_line_keys(pos, li, ["l_orderkey", "l_linenumber"])


@query("load_report", " union all ".join(f"select '{t}' as \"table\", count(*) as rows from {t}" for t in ("orders", "lineitem", "documents", "events")))
def load_report(spark, sf):
    return T.load_report({t: table(spark, sf, t) for t in ("orders", "lineitem", "documents", "events")})


@query("parent_departments", """select lower(n_name) as slug, r_name as parent_name from nation join region on n_regionkey = r_regionkey
union all select lower(r_name), null from region""")
def parent_departments(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    v = F.lit("F").alias("budget_version")
    kids = n.join(r, n.n_regionkey == r.r_regionkey).select(v, F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.lower("r_name").alias("parent"))
    tops = r.select(v, F.lower("r_name").alias("slug"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    return T.with_parents(kids.unionByName(tops)).select("slug", "parent_name")


@query("version_replace", f"""with {DEPT_SUMMARY} select v as budget_version, dept, metric,
  case when v = 'F' then proposed_2027 + 1 else proposed_2027 end as proposed_2027 from ds""")
def version_replace(spark, sf):
    """All versions loaded in one write, then one of them again with other figures."""
    root = f"{checkpoint_root(spark)}/versions-{uuid.uuid4().hex}"
    rows = B.dept_summary(spark, sf).select("budget_version", "dept", "metric", "proposed_2027")
    S.replace_versions(spark, root, {"dept_summary": rows})
    S.replace_version(spark, root, "F", {"dept_summary": rows.withColumn("proposed_2027", F.col("proposed_2027") + 1)})
    return S.read_version(spark, root, "dept_summary").select("budget_version", "dept", "metric", "proposed_2027")


@query("snapshot_replace", """select c_custkey, c_name, '2026-09-24' as budget_version from customer
union all select c_custkey, c_name, '2026-09-23' from customer where c_custkey % 2 = 0""")
def snapshot_replace(spark, sf):
    """A snapshot of the even customers, one whose row count is wrong and is not switched to, and one of all."""
    root = f"{checkpoint_root(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    even = rows.where(F.col("c_custkey") % 2 == 0)
    S.replace_snapshot(spark, root, "2026-09-23", even, even.count())
    try:
        S.replace_snapshot(spark, root, "2026-09-23", rows, even.count())
    except ValueError:
        pass
    S.replace_snapshot(spark, root, "2026-09-24", rows, rows.count())
    return S.read_version(spark, root, "parcels")


@query("table_round_trip", """select 'parquet' as form, o_orderkey as key, cast(floor(o_totalprice * 100 + 0.5) as bigint) as value from orders
union all select 'lines', o_orderkey, cast(floor(o_totalprice * 100 + 0.5) as bigint) from orders
union all select 'document', c_custkey, cast(c_nationkey as bigint) from customer""")
def table_round_trip(spark, sf):
    """Orders as revenues written with declared types as parquet and as JSON lines, customers as JSON documents of 512 at most,
    read back."""
    root = f"{checkpoint_root(spark)}/forms-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders")
    rows = o.select(F.lit("F").alias("budget_version"), F.lit("summary").alias("source"), F.col("o_orderkey").cast("string").alias("line"), B.cents("o_totalprice").alias("proposed_2027"))
    T.write_table(rows, f"{root}/revenues", "revenues", ["budget_version"])
    T.write_lines(T.conform(rows, "revenues"), f"{root}/lines")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    packs = c.groupBy(F.floor(F.col("c_custkey") / 512).alias("pack")).agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.array("c_nationkey").alias("refs"))).alias("rows"))
    packs.select("pack", F.to_json("rows").alias("value")).write.partitionBy("pack").text(f"{root}/documents")
    pick = lambda df, form: df.select(F.lit(form).alias("form"), F.col("line").cast("long").alias("key"), F.col("proposed_2027").alias("value"))
    docs = T.read_document(spark, f"{root}/documents", "id string, refs array<bigint>").select(F.lit("document").alias("form"), F.col("id").cast("long").alias("key"), F.get("refs", F.lit(0)).alias("value"))
    return pick(T.read_table(spark, f"{root}/revenues", "revenues"), "parquet").unionByName(pick(T.read_lines(spark, f"{root}/lines", "revenues"), "lines")).unionByName(docs)


@query("property_csv", """select lpad(c_custkey::varchar, 10, '0') as taxkey, case when c_acctbal > 0 then cast(floor(c_acctbal * 100 + 0.5) as bigint) end as c_a_total, cast(c_custkey % 7 as integer) as nr_units,
  case when c_nationkey > 11 then 'O' end as own_ocpd from customer""")
def property_csv(spark, sf):
    """Customers written as the property file, a text column each with blanks around and owners' names in it, and read back."""
    from tallybook import fixed_values as V

    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    p = B.parcels(spark, sf)
    given = {"TAXKEY": F.col("taxkey"), "C_A_TOTAL": F.col("c_a_total").cast("string"), "NR_UNITS": F.col("nr_units").cast("string"), "OWN_OCPD": F.col("own_ocpd"), "YR_ASSMT": F.col("yr_assmt")}
    p.select(*[F.concat(F.lit(" "), F.coalesce(given.get(k, F.lit("")), F.lit("")), F.lit(" ")).alias(k) for k in V.PARCEL_KEEP], F.lit("A Person").alias("OWNER_NAME_1")).write.option(
        "header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.read_property_csv(spark, path, "2026-09-24").select("taxkey", "c_a_total", "nr_units", "own_ocpd")


def requests(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


ADMISSION = f"""with recursive r as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, event_id, rn, [ts] as recent, true as allowed from r where rn = 1
  union all select r.user_id, r.event_id, r.rn, case when len(k) < {LIMIT} then list_append(k, r.ts) else k end, len(k) < {LIMIT}
  from (select f.*, r2.ts as now, list_filter(f.recent, lambda x: r2.ts - x < interval {WINDOW} seconds) as k from f join r r2 on r2.user_id = f.user_id and r2.rn = f.rn + 1) g
  join r on r.user_id = g.user_id and r.rn = g.rn + 1)
select user_id::varchar as key, event_id, allowed from f"""


@query("admission", ADMISSION)
def admission(spark, sf):
    """Two requests a day per visitor, over a sliding day."""
    return R.admission(requests(spark, sf), LIMIT, WINDOW).select("key", "event_id", "allowed")


@query("admission_stream", ADMISSION)
def admission_stream(spark, sf):
    """The same rule on the event table read as a stream, written to the shared folder and read back."""
    root = f"{checkpoint_root(spark)}/admission-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    asked = events.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    with R.rocksdb_state(spark):
        run = R.admission_stream(asked, LIMIT, WINDOW).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option(
            "path", f"{root}/out").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(R.ADMITTED).parquet(f"{root}/out").select("key", "event_id", "allowed")


@query("daily_cap", """with d as (select event_id, ts, strftime(timezone('America/Chicago', ts at time zone 'UTC'), '%Y-%m-%d') as day from events)
select event_id, day, row_number() over (partition by day order by ts, event_id) <= 100 as allowed from d""")
def daily_cap(spark, sf):
    asked = table(spark, sf, "events").select("event_id", "ts")
    return R.daily_cap(asked, 100).select("event_id", F.col("day").cast("string").alias("day"), "allowed")


@query("blank_runs", """with r as (select conv_id, max(turn) as last, count_if(role = 'assistant' and turn % 2 = 1 and length(text) >= 200) as texts from conversations group by 1)
select conv_id::varchar as run_id, case when texts = 0 then 3 else 0 end as added from r""")
def blank_runs(spark, sf):
    """Turns as events of a run: long assistant turns are text, others are blank; the run finishes after its last turn."""
    c = table(spark, sf, "conversations")
    t0 = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = lambda n: F.timestamp_seconds(F.unix_timestamp(t0) + n)
    long = (F.col("role") == "assistant") & (F.col("turn") % 2 == 1) & (F.length("text") >= 200)
    turns = c.select(F.col("conv_id").cast("string").alias("run_id"), F.lit("TEXT_MESSAGE_CONTENT").alias("type"),
                     F.when(long, F.col("text")).otherwise("  ").alias("delta"), at(F.col("turn")).alias("ts"))
    ends = c.groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(F.max("turn").alias("last")).select(
        "run_id", F.lit("RUN_FINISHED").alias("type"), F.lit(None).cast("string").alias("delta"), at(F.col("last") + 1).alias("ts"))
    out = R.blank_runs(turns.unionByName(ends))
    return out.groupBy("run_id").agg(F.sum(F.col("added").cast("int")).cast("int").alias("added"))
