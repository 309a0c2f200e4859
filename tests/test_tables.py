from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.operators import checks as K, passages as P, retrieval as R
from tallybook.sources import tables as T, versions as S
from tallybook.streaming import requests as Q


def test_property_file_keeps_no_owner(spark, tmp_path):
    head = T.V.PARCEL_KEEP + T.V.PARCEL_NEVER
    row = {c: "" for c in head} | {"TAXKEY": " 4000708100 ", "HOUSE_NR_LO": "2401", "HOUSE_NR_HI": "2401", "C_A_TOTAL": "200000",
                                   "NR_UNITS": "1", "LOT_AREA": "4800.5", "OWNER_NAME_1": "SECRET"}
    (tmp_path / "p.csv").write_text(",".join(head) + "\n" + ",".join(row[c] for c in head) + "\n")
    df = T.read_property_csv(spark, str(tmp_path / "p.csv"), "2026-09-23")
    got = df.first()
    assert (got["taxkey"], got["c_a_total"], got["p_a_total"], float(got["lot_area"])) == ("4000708100", 200000, None, 4800.5)
    assert K.forbidden_columns(df) == [] and "SECRET" not in str(got)
    row["NR_UNITS"] = "two"
    (tmp_path / "bad.csv").write_text(",".join(head) + "\n" + ",".join(row[c] for c in head) + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        T.read_property_csv(spark, str(tmp_path / "bad.csv"), "2026-09-23").collect()


def test_a_version_is_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "lake")
    a = spark.createDataFrame([("v1", "x", 1), ("v2", "x", 2)], "budget_version string, k string, n int")
    for v in ("v1", "v2"):
        S.replace_version(spark, root, v, {"t": a})
    S.replace_version(spark, root, "v1", {"t": a.withColumn("n", F.col("n") + 10)})
    assert sorted((r["budget_version"], r["n"]) for r in S.read_version(spark, root, "t").collect()) == [("v1", 11), ("v2", 2)]
    with pytest.raises(ValueError, match="not switched"):
        S.replace_version(spark, root, "v2", {"t": a}, {"t": 5})
    assert S.read_version(spark, root, "t", "v2").count() == 1
    with pytest.raises(ValueError, match="expected 3"):
        S.replace_snapshot(spark, root, "2026-09-23", a.drop("budget_version"), 3)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("v", "s", "12.50")], "budget_version string, fee string, value_2027 string")
    T.write_table(df, str(tmp_path / "fees"), "fees")
    got = T.read_table(spark, str(tmp_path / "fees"), "fees").first()
    assert float(got["value_2027"]) == 12.5 and got["value_2026"] is None
    T.write_lines(df, str(tmp_path / "lines"))
    assert T.read_lines(spark, str(tmp_path / "lines"), "fees").first()["fee"] == "s"
    (tmp_path / "meta.json").write_text('{\n "rows": 3\n}')
    assert T.read_document(spark, str(tmp_path / "meta.json"), "rows long").first()["rows"] == 3


def test_admission_ignores_rejected_requests(spark):
    rows = [("a", i, f"2026-01-01 00:{m:02d}:00") for i, m in enumerate((0, 1, 2, 3, 10, 11, 12))]
    df = spark.createDataFrame(rows, "key string, event_id long, t string").select("key", "event_id", F.col("t").cast("timestamp").alias("ts"))
    got = [r["allowed"] for r in Q.admission(df, 2, 600).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False]


def _by_turns(times, limit, window):
    """The rule row by row."""
    recent, out = [], []
    for t in times:
        recent = [r for r in recent if t - r < window]
        out.append(len(recent) < limit)
        recent += [t] * out[-1]
    return out


@pytest.mark.parametrize("limit,window,block", [(0, 60, 64), (1, 60, 64), (5, 40, 33), (2, 300, 1000)])
def test_admission_over_blocks(spark, limit, window, block):
    """One visitor without a pause over many blocks, among small ones; equal times, and a session far from UTC."""
    rng = np.random.default_rng(limit + block)
    seconds = {"busy": np.sort(rng.integers(0, 3000, 500)), "one": np.array([5]), "two": np.array([7, 7, 7, 4000])}
    rows = [(k, i * 10 + j, int(t)) for j, (k, ts) in enumerate(seconds.items()) for i, t in enumerate(ts)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        df = spark.createDataFrame(rows, "key string, event_id long, s long").select("key", "event_id", F.timestamp_seconds(F.col("s") + 1793516400).alias("ts"))
        got = {(r["key"], r["event_id"]): r["allowed"] for r in Q.admission(df, limit, window, block).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = {(k, i * 10 + j): a for j, (k, ts) in enumerate(seconds.items()) for i, a in enumerate(_by_turns(ts.tolist(), limit, window))}
    assert got == want


def _streamed(spark, tmp_path, df, build, columns):
    for i, part in enumerate(df):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with Q.rocksdb_state(spark):
        run = build(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option(
            "path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).select(*columns)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    ts = lambda i: f"2026-01-01 {i // 4:02d}:{i % 4 * 15:02d}:00"
    rows = [(k, i * 2 + (k == "b"), ts(i)) for i in range(40) for k in "ab"]
    df = spark.createDataFrame(rows, "key string, event_id long, t string").select("key", "event_id", F.col("t").cast("timestamp").alias("ts"))
    parts = [df.where(F.col("event_id").between(i * 20, i * 20 + 19)) for i in range(4)]
    want = Q.admission(df, 3, 3600).select("key", "event_id", "allowed")
    got = _streamed(spark, tmp_path, parts, lambda s: Q.admission_stream(s, 3, 3600), want.columns)
    assert K.same_rows(got, want).count() == 0


def test_daily_cap_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-01-0{1 + i // 10} 1{i % 10}:00:00") for i in range(20)], "event_id long, t string").select(
        "event_id", F.col("t").cast("timestamp").alias("ts"))
    want = Q.daily_cap(df, 4).select("day", "event_id", "allowed")
    got = _streamed(spark, tmp_path, [df.where("event_id < 7"), df.where("event_id >= 7")], lambda s: Q.daily_cap_stream(s, 4), want.columns)
    assert K.same_rows(got, want).count() == 0


def test_blank_run_stream(spark, tmp_path):
    rows = [("r1", "TEXT_MESSAGE_CONTENT", "hi", 0), ("r1", "RUN_FINISHED", None, 1), ("r2", "TEXT_MESSAGE_CONTENT", "  ", 0),
            ("r2", "RUN_FINISHED", None, 1)]
    df = spark.createDataFrame(rows, "run_id string, type string, delta string, s int").select(
        "run_id", "type", "delta", F.timestamp_seconds(F.lit(1767225600) + F.col("s")).alias("ts"))
    assert Q.blank_runs(df).where("added and delta is not null").select("run_id").collect() == [("r2",)]
    got = _streamed(spark, tmp_path, [df.where("s = 0"), df.where("s = 1")], Q.blank_runs_stream, ["run_id"])
    assert got.collect() == [("r2",)]


def test_addresses_collapse_and_keep_direction(spark):
    rows = [("4000708100", 2401, 2401, "W", "WISCONSIN", "AV"), ("1", 3120, 3120, "S", "48TH", "ST"), ("2", 3118, 3118, "N", "48TH", "ST"),
            ("3", 1300, 1300, "N", "PROSPECT", "AV"), ("4", 1300, 1300, "N", "PROSPECT", "AV"), ("5", 10, 20, "E", "JUNEAU", "AV")]
    parcels = spark.createDataFrame([(k, a, b, None, d, s, t) for k, a, b, d, s, t in rows],
                                    "taxkey string, house_nr_lo int, house_nr_hi int, house_nr_sfx string, sdir string, street string, sttype string")
    typed = ["2401 w wiscosin", "3120 N 48th St", "1300 n prospect ave", "12 e juneau", "2401 Wisconsin Ave"]
    q = spark.createDataFrame(list(enumerate(typed)), "query_id int, typed string")
    best = {r["query_id"]: r for r in R.search_addresses(q, parcels).where("rank = 1").collect()}
    assert best[0]["taxkey"] == "4000708100" and best[4]["address"] == "2401 W WISCONSIN AV"
    assert best[1]["address"] == "3118 N 48TH ST"
    assert (best[2]["taxkey"], best[2]["parcels"], best[2]["exact_number"]) == (None, 2, True)
    assert (best[3]["address"], best[3]["exact_number"]) == ("10-20 E JUNEAU AV", True)


def test_similar_pairs_equal_brute_force(spark):
    from tallybook.functions.trigrams import word_similarity

    words = ["general office", "genral ofice", "office", "police", "polic", "fire", "fier dept", "fire department", "street st", "a"]
    p = spark.createDataFrame([(w,) for w in words], "phrase string").withColumn("p", F.col("phrase"))
    t = p.select(F.col("p").alias("t"), F.col("phrase").alias("text"))
    for s in (0.3, 0.5, 0.6, 1.0):
        brute = p.crossJoin(t).where(word_similarity(F.col("phrase"), F.col("text")) >= s).select("p", "t")
        assert K.same_rows(R.similar_pairs(p, t, s).select("p", "t"), brute).count() == 0


def test_passages_of_a_department(spark):
    long = " ".join(f"Sentence number {i} says something about the fire budget." for i in range(60))
    text = "\n".join(["FIRE DEPARTMENT", "MISSION: To protect life and property through prompt response everywhere.", "SERVICE HIGHLIGHTS", "•",
                      "The department trains recruits every year and keeps every engine house open at night.", "•", "Too short.",
                      "BUDGET SUMMARY", "Salaries 1,234 5,678", "CAPITAL PROJECTS", long])
    pages = spark.createDataFrame([("summary", 40, text)], "doc string, page int, text string")
    depts = spark.createDataFrame([(40, "fire", "Fire Department")], "page int, dept string, dept_name string")
    rows = P.narrative_passages(pages, depts, ["doc"]).orderBy("ordinal").collect()
    assert [r["section_type"] for r in rows[:2]] == ["mission", "service_highlight"]
    assert rows[0]["id"] == "department:fire:mission:1" and rows[0]["context_header"].endswith("Summary p.30")
    assert all(8 <= len(r["text"].split()) <= 320 for r in rows) and all("1,234" not in r["text"] for r in rows)
    assert len({r["id"] for r in rows}) == len(rows)


def test_found_on_page(spark):
    words = spark.createDataFrame([("d", 1, 1, t, x, x + 20.0) for t, x in (("Salaries", 40.0), ("paid", 80.0), ("1,234", 200.0), ("-", 260.0),
                                                                            ("(5)", 300.0))],
                                  "doc string, page int, line int, text string, x0 double, x1 double")
    lines = K.value_lines(words, ["doc", "page"], x_min=170.0)
    rows = spark.createDataFrame([("a", "d", 1, "Salaries paid out"), ("b", "d", 1, "Other label"), ("c", "d", 1, "Salaries paid")],
                                 "id string, doc string, page int, label string").withColumn(
        "expected", F.array(F.lit(1234).cast("decimal(20,4)"), F.lit(None), F.when(F.col("id") == "c", 6).otherwise(-5).cast("decimal(20,4)")))
    got = {r["id"]: r["status"] for r in K.found_on_page(rows, lines, ["doc", "page"], ["id"]).collect()}
    assert got == {"a": "ok", "b": "values_ok_label_not_on_line", "c": "MISMATCH"}


def test_glossary_and_fee_gaps(spark):
    g = spark.createDataFrame([("Levy", 1, "levy", "The property tax."), ("FTE", 1, "full-time", "About $5 each.")],
                              "term string, page int, cite_text string, plain_definition string")
    pages = spark.createDataFrame([(1, "The city’s levy")], "page int, page_text string")
    assert sorted((r["term"], r["problem"]) for r in K.glossary_gaps(g, pages).collect()) == [
        ("FTE", "states an amount"), ("FTE", "term not on page")]


def test_islands_are_scanned_without_text(spark, monkeypatch):
    from tallybook.operators import passages as P

    pages = spark.createDataFrame([("d", p, "FIRE DEPARTMENT\nMISSION: to serve the people of this city well and always on time.") for p in (11, 12)], "doc string, page int, text string")
    depts = spark.createDataFrame([("d", p, "fire", "Fire") for p in (11, 12)], "doc string, page int, dept string, dept_name string")
    scanned = []
    for name in ("running_count", "carry_last"):
        monkeypatch.setattr(P, name, lambda df, keys, order, value, out, *a, f=getattr(P, name): scanned.append((out, set(df.columns))) or f(df, keys, order, value, out, *a))
    rows = P.narrative_passages(pages, depts, ["doc"]).collect()
    assert sorted(r["pdf_page"] for r in rows) == [11, 12]
    assert [c for out, c in scanned if out == "heading" and "line" in c] == []
    assert [c for out, c in scanned if out == "_island" and "run" in c and "line" in c] == []


def test_units_are_dealt_once(spark):
    """Lines are read once for the items, the totals and the ends of the units, and no unit is joined with itself."""
    from tallybook.plans import check_plans

    plan = check_plans.reconcile_units(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") <= 3


def test_parts_follow_the_lines(spark, monkeypatch):
    from tallybook.plans import check_plans

    rows = check_plans.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    monkeypatch.setattr(check_plans, "PART_LINES", 500, raising=False)
    lines = check_plans.numbered_lines(spark, "/root/testdata/sf0.001", "l_quantity")
    assert lines.rdd.getNumPartitions() == 1 + rows // 500 > 8
