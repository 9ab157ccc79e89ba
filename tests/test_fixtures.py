"""Small hand-made tables with known findings."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates as A
from plumbline.operators import anomaly as N
from plumbline.operators import audit as H
from plumbline.operators import clean as C
from plumbline.operators import fuzzy as Z
from plumbline.operators import joins as J
from plumbline.operators import privacy as P
from plumbline.operators import projection as Q
from plumbline.operators import reshape as R
from plumbline.operators import stats as S
from plumbline.plans import checks as K
from plumbline.plans import layers as L
from plumbline.plans.validate import validate
from plumbline.sources import files, messages, nested
from plumbline.streaming import validator as V


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def clinical(spark):
    d = dt.date
    rows = [
        ("P001", "F", 34, d(2024, 1, 5), d(2024, 1, 9), "true", 120.0, 80.0, "France"),
        ("P002", "M", 12, d(2024, 1, 6), d(2024, 1, 8), "true", -50.0, 81.0, "FRA"),
        ("P003", "F", 9, d(2024, 2, 1), d(2024, 1, 20), "true", 300.0, 150.0, "French"),
        ("P004", "M", 51, d(2099, 3, 1), d(2099, 3, 4), "false", 210.0, 77.0, "Germany"),
        ("P005", "F", 45, d(2024, 3, 9), d(2024, 3, 1), "false", -10.0, 60.0, "France"),
        (None, "M", 70, d(2024, 4, 1), d(2024, 4, 3), "true", 95.0, 70.0, "Germany"),
        ("P007", "F", 28, d(2024, 4, 5), d(2024, 4, 6), "false", 88.0, 66.0, "France"),
        ("P008", "M", 33, d(2024, 5, 1), d(2024, 5, 2), "false", 77.0, 90.0, "Germany"),
        ("P008", "M", 33, d(2024, 5, 1), d(2024, 5, 2), "false", 77.0, 90.0, "Germany"),
        ("P010", "F", 61, d(2024, 6, 1), d(2024, 6, 7), "true", 64.0, 91.0, "France"),
    ]
    return spark.createDataFrame(
        rows, "patient_id string, sex string, age int, admit_date date, discharge_date date, has_retirement_account string, claim_amount double, success_rate double, country string"
    )


def test_clinical_findings(spark, clinical):
    f = validate(clinical, "patient_id", as_of=F.lit("2025-01-01").cast("date"), category_columns=["country"])
    got = {(r.layer, r.rule, tuple(r.columns)): r["count"] for r in f.collect()}
    assert got["unit_tests", "negative", ("claim_amount",)] == 2
    assert got["unit_tests", "future_date", ("admit_date",)] == 1
    assert got["unit_tests", "blank_key", ("patient_id",)] == 1
    assert got["unit_tests", "duplicate", ()] == 1
    assert got["cross_column", "date_order", ("admit_date", "discharge_date")] == 2
    assert got["cross_column", "minor_adult_status", ("age", "has_retirement_account")] == 2
    assert got["bounds", "rate_like_bounds", ("success_rate",)] == 1
    assert any(k[0] == "categorical" for k in got)
    grades = by(L.calibrated_grades(f), "axis", "score", "grade")
    assert grades["integrity"][0] < 0.7
    assert not L.readiness_verdict(f).first().consumable


def test_abbreviation_cluster(spark, clinical):
    rows = Z.category_clusters(clinical, "country").collect()
    france = {r.value for r in rows if r.canonical == "France"}
    assert {"France", "FRA"} <= france


def test_healthcare_pack_softens_shifted_dates(spark):
    d = spark.createDataFrame([(i, dt.date(2150, 1, 1)) for i in range(20)], "k int, visit_date date")
    f = L.apply_pack(L.unit_tests(d, "k"), "healthcare")
    r = f.where("rule = 'future_date'").first()
    assert (r.status, r.reinterpreted) == ("warn", True)


def test_group_imputation(spark):
    rows = [("north", 10.0), ("north", 20.0), ("north", None), ("south", 200.0), ("south", None), ("east", None), (None, 7.0), (None, None)]
    d = spark.createDataFrame(rows, "region string, score double")
    got = {(r.region, r.score_imputed) for r in C.impute_group_mean(d, "score", ["region"]).where("score is null").collect()}
    assert got == {("north", 15.0), ("south", 200.0), ("east", (10 + 20 + 200 + 7) / 4), (None, 7.0)}


def test_format_repairs(spark):
    rows = [("$1,200.50", "01/05/2024", "N/A"), ("$300", "2024-01-06", "ok"), ("$4.5", "03/07/2024", "n/a"), ("$99", "2024-02-01", "NULL"), ("$7", "2024-02-02", "fine")]
    d = spark.createDataFrame(rows, "amount string, dt string, note string")
    assert {(r.column, r.issue) for r in C.scan_formats(d).collect()} == {("amount", "currency_text"), ("dt", "mixed_dates"), ("note", "fake_null")}
    x = C.fix_fake_nulls(C.fix_dates(C.fix_currency(d, "amount"), "dt"), "note")
    assert x.where("amount_num = 1200.5 and dt_date = date'2024-01-05' and note is null").count() == 1
    assert x.where("dt_date is null").count() == 0


def test_foreign_keys_and_coverage(spark):
    p = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "patient_id string")
    e = spark.createDataFrame([("E1", "P1"), ("E2", "P2"), ("E3", "GHOST1"), ("E4", "GHOST2"), ("E5", "GHOST3"), ("E6", None)], "encounter_id string, patient_id string")
    r = J.check_foreign_key(e, "patient_id", p, "patient_id").first()
    assert (r.total_rows, r.orphan_count, r.null_count, r.orphan_rate, r.status) == (5, 3, 1, 0.6, "fail")
    assert r.orphan_sample == ["GHOST1", "GHOST2", "GHOST3"]
    c = J.check_join_coverage(e, "patient_id", p, "patient_id").first()
    assert (c.child_coverage, c.parent_matched, c.status) == (0.4, 2, "fail")


def test_null_safe_join_and_outer_key(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (7, "r")], "id int, v string")
    assert J.join_tables(a, b, "k", "id", null_safe=True).count() == 2
    full = J.join_tables(a, b, "k", "id", "full")
    assert {(r.k, r.v, r.v_B) for r in full.collect()} == {(1, "x", "p"), (None, "y", None), (None, None, "q"), (7, None, "r")}


def test_flag_and_temporal_rules(spark):
    d = spark.createDataFrame([(0, 1, 0, 1, 1, "2024-01-05", "2024-01-02"), (1, 1, 1, 1, 0, "2024-01-05", "2024-01-09"), (1, 0, 0, 0, 0, "bad", "2024-01-09")], "readmit_7d int, readmit_30d int, readmit_90d int, inpatient int, outpatient int, admit_date string, discharge_date string")
    got = by(K.run_rules(d, K.flag_rules() + K.temporal_rules(d.columns)), "rule", "count", "status")
    assert got["readmit_30d_implies_90d"] == (1, "fail")
    assert got["readmit_7d_implies_30d"] == (1, "fail")
    assert got["inpatient_outpatient_exclusive"] == (1, "fail")
    assert got["admit_before_discharge"] == (1, "fail")
    assert "deceased_live_discharge" not in got
    assert K.violations(d, K.flag_rules()).count() == 2


def test_pivot_and_crosstab(spark):
    rows = [("c1", "North", "Aetna", 100.0, 1), ("c2", "North", "Aetna", 200.0, 2), ("c3", "North", "Cigna", 50.0, 1), ("c4", "South", "Aetna", 300.0, 3), ("c5", "South", "Cigna", 150.0, 1)]
    d = spark.createDataFrame(rows, "claim_id string, region string, payer string, amount double, quantity int")
    assert by(A.pivot(d, ["region"], "payer", "amount", "sum"), "region", "Aetna", "Cigna") == {"North": (300.0, 50.0), "South": (300.0, 150.0)}
    x = {(r.row_key, r.column_key): r.value for r in A.crosstab(d, "region", "payer", "amount").collect()}
    assert x[None, None] == 800.0 and x["North", None] == 350.0 and x[None, "Cigna"] == 200.0
    wide = spark.range(201).select(F.lit("r").alias("r"), F.col("id").alias("c"), F.lit(1).alias("v"))
    assert A.pivot_cardinality(wide, "c") == 201 and len(A.pivot(wide, ["r"], "c", "v", "sum").columns) == 202
    assert A.pivot_long(wide, ["r"], "c", "v", "sum").count() == 201


def test_claim_root_causes(spark):
    d = dt.date
    rows = [
        ("C1", "M1", d(2024, 1, 1), "99213", "E11.9", "1234567893", None),
        ("C2", None, d(2024, 1, 1), "99213", "E11.9", "1234567890", None),
        ("C3", "M3", d(2024, 1, 1), "9921", "", "1234567893", None),
        ("C4a", "M4", d(2024, 2, 1), "99214", "E11.9", "1234567893", None),
        ("C4b", "M4", d(2024, 2, 1), "99214", "E11.9", "1234567893", None),
        ("C4c", "M4", d(2024, 2, 2), "99214", "E11.9", "1234567893", None),
        ("C5", "M5", d(2024, 3, 1), "99213", "E11.9", "1234567893", "Second"),
    ]
    df = spark.createDataFrame(rows, "claim_id string, member_id string, dos date, cpt string, dx string, npi string, payer2 string")
    f = L.claim_root_causes(df, "claim_id", "member_id", "dos", "cpt", "dx", "npi", "payer2")
    hit = lambda c: {r.claim_id for r in f.where(c).collect()}
    assert hit("eligibility") == {"C2"} and hit("coding") == {"C3"} and hit("provider") == {"C2"} and hit("cob") == {"C5"}
    assert hit("duplicate") == {"C4b", "C4c"}
    assert by(L.claim_report(f), "cause", "lines", "cost")["any"] == (5, 590.0)


def test_convergence_transitive_and_trust(spark):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    a = mk([("C1", 100)], "claim_id string, amt int")
    b = mk([("C1", "P1", "2026-01-01")], "claim_id string, patient_id string, date_of_service string")
    c = mk([("P1", "2026-01-01", "Y")], "patient_id string, date_of_service string, elig string")
    keys = ("date_of_service", "patient_id")
    clusters, _ = Z.converge([Z.Source("A", a, (("claim_id",),)), Z.Source("B", b, (("claim_id",), keys)), Z.Source("C", c, (keys,))])
    r = clusters.collect()
    assert len(r) == 1 and r[0].sources == ["A", "B", "C"] and not r[0].has_conflict
    pair = lambda x, y, tx, ty: Z.converge([Z.Source("A", mk([("X", x)], "id string, paid string"), (("id",),), tx), Z.Source("B", mk([("X", y)], "id string, paid string"), (("id",),), ty)])
    _, res = pair("500", "450", 0.9, 0.6)
    assert (res.first().resolved, res.first().value, res.first().source) == (True, "500", "A")
    cl, res = pair("412.00", "398.50", 0.75, 0.65)
    assert not res.first().resolved and cl.first().escalated
    cl, res = pair("412.00", "412", 0.75, 0.65)
    assert res.count() == 0 and not cl.first().has_conflict


def test_stream_validator_and_replay(spark, tmp_path):
    v = V.StreamValidator(spark, "s", str(tmp_path / "state"), ["amount"])
    base = spark.range(100).select("id", (F.lit(10.0) + F.col("id") % 3).alias("amount"))
    v.process(base, 0)
    v.process(base.withColumn("amount", F.when(F.col("id") >= 15, F.col("amount"))), 1)
    v.process(base.withColumn("amount", F.col("amount") + 100), 2)
    v.process(base.union(base), 3)
    v.process(base.withColumn("extra", F.lit(1)), 4)
    want = {0: "pass", 1: "warn", 2: "fail", 3: "fail", 4: "fail"}
    got = {r.batch_id: r for r in v.findings().collect()}
    assert {k: r.status for k, r in got.items()} == want
    assert got[1].null_spike and got[2].mean_shift and got[3].arrival_anomaly and got[4].schema_drift
    v.process(base.union(base), 3)
    assert v.findings().count() == 5
    t = V.session_totals(v.findings()).orderBy("batch_id").collect()
    assert [r.total_rows for r in t] == [100, 200, 300, 500, 600]
    assert {r.batch_id: r.schema_changed for r in V.batch_changes(v.findings()).collect()}[4]


def test_stream_from_files(spark, tmp_path):
    src = tmp_path / "in"
    d = spark.range(60).select("id", (F.col("id") * 1.0).alias("amount"))
    for i in range(3):
        d.where(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(src))
    v = V.StreamValidator(spark, "f", str(tmp_path / "state"), ["amount"])
    stream = files.watch_folder(spark, str(src), d.schema, files_per_batch=1)
    v.start(stream, str(tmp_path / "log")).awaitTermination()
    assert v.findings().count() == 3 and v.findings().agg(F.sum("rows")).first()[0] == 60


def test_grid_recipe(spark):
    cells = [
        ["Quarterly report", None, None, None], [None] * 4, ["Region", "Sales", "", "Sales"], ["Name", "Q1", "", "Q2"], ["North", "1,000", "", "2.5"], ["South", " 2000 ", "", "3.5"], ["", "", "", ""], ["East", "30", "", "4.5"], ["Total", "3030", "", "10.5"], ["source: ledger", None, None, None],
    ]
    g = spark.createDataFrame(list(enumerate(cells)), "row_id long, cells array<string>")
    recipe = R.plan_grid_repair(g)
    assert recipe.header_rows == [2, 3] and recipe.last_row == 7
    out = R.apply_grid_repair(g, recipe)
    assert out.columns == ["row_id", "Region / Name", "Sales / Q1", "Sales / Q2"]
    assert [r["Sales / Q2"] for r in out.orderBy("row_id").collect()] == [2.5, 3.5, 4.5]


def test_grid_far_header_and_long_footer(spark):
    rows = [[f"note {i}", None, None] for i in range(40)] + [["Name", "Day", "Amount"]] + [[f"n{i}", "2024-01-02", f"{i}"] for i in range(20)]
    rows += [["Total", "x", f"{i}"] for i in range(1000)]
    g = spark.createDataFrame(list(enumerate(rows)), "row_id long, cells array<string>")
    recipe = R.plan_grid_repair(g)
    assert recipe.header_rows == [40] and recipe.last_row == 60 and recipe.names == ["Name", "Day", "Amount"]
    assert recipe.types == {"Day": "date", "Amount": "bigint"} and R.apply_grid_repair(g, recipe).count() == 20


def test_name_words():
    assert K.name_tokens("LOSDays") == ["los", "days"] and K.name_tokens("admit_dateTime2 X") == ["admit", "date", "time2", "x"]


def test_unpivot_suggestion_and_guard(spark):
    d = spark.createDataFrame([("a", "x", 1.0, None), ("b", "y", 3.0, 4.0)], "name string, kind string, Jan double, Feb double")
    keep, wide = R.suggest_unpivot(d)
    assert keep == ["name", "kind"] and wide == ["Jan", "Feb"]
    assert R.unpivot(d, keep, wide, "month", "sales").count() == 3
    with pytest.raises(ValueError):
        R.unpivot(d, ["Jan"], ["Jan"])


def test_messages(spark):
    bodies = ['{"a":1}', '[{"a":1},3]', '{"a":1}\n{"a":2}\nnope', 'x,"y, z",5', "{bad", "", "[1]"]
    d = spark.createDataFrame([(i, b.encode()) for i, b in enumerate(bodies)] + [(9, b"\xff\xfe\x00")], "i int, value binary")
    rows = messages.parse_messages(d, keys=["i"]).collect()
    n = lambda i: (sum(r.i == i and r.record is not None for r in rows), sum(r.i == i and r.error is not None for r in rows))
    assert [n(i) for i in (0, 1, 2, 3, 4, 5, 6, 9)] == [(1, 0), (1, 1), (2, 1), (1, 0), (0, 1), (0, 1), (0, 1), (1, 0)]
    cell = next(json.loads(r.record) for r in rows if r.i == 3)
    assert cell == {"col1": "x", "col2": "y, z", "col3": "5"}
    s = spark.createDataFrame([("a.b.c",), ("a.x",), ("a",)], "s string")
    hit = lambda p: {r.s for r in s.where(messages.subject_matches(F.col("s"), p)).collect()}
    assert hit("a.>") == {"a.b.c", "a.x"} and hit("a.*") == {"a.x"} and hit("a.*.c") == {"a.b.c"} and hit("") == set()


def test_flatten_files_and_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"meta": {"n": 1}, "data": {"rows": [{"a": {"b": 1}, "t": [1, 2]}, {"a": {"b": 2}}]}}')
    d = nested.records(files.load_json(spark, str(tmp_path / "x.json"), multiline=True).select(F.struct("*").alias("p")), "p")
    assert {(r["a.b"], r["t"]) for r in d.collect()} == {(1, "[1,2]"), (2, None)}
    (tmp_path / "x.csv").write_text("id,amount\n1,2.5\noops,3\n3,4.5\n")
    good, tally = files.load_csv(spark, str(tmp_path / "x.csv"), "id int, amount double")
    assert good.count() == 2 and tally.first().rejected == 1
    (tmp_path / "x.log").write_text("\n".join(f"2024-01-0{i % 9 + 1} INFO line {i}" for i in range(300)))
    lines = files.load_text_lines(spark, str(tmp_path / "x.log"))
    assert [r.content.split()[-1] for r in lines.orderBy("line_number").collect()] == [str(i) for i in range(300)]
    assert files.text_kind(lines, "file").first().kind == "log"
    assert files.format_of("s3a://b/k.csv.gz") == "csv"
    t = files.promote_types(spark.createDataFrame([("1", "2024-01-02", "a"), (None, "2024-1-5", "2")], "n string, d string, s string"))
    assert [f.dataType.simpleString() for f in t.schema.fields] == ["double", "date", "string"]


def test_anomaly_rank_and_forest(spark):
    rows = [(i, 30 + i % 7, 100.0 + i % 11, "A" if i % 2 else "B") for i in range(80)]
    rows[40] = (40, 33, 5000.0, "Z")
    d = spark.createDataFrame(rows, "user_id int, age int, amount double, region string")
    s = N.flag_outlying_scores(N.gower_knn(d, "user_id", ["age", "amount"], ["region"]))
    top = s.orderBy(F.desc("raw_score")).first()
    assert top.key == 40 and top.is_anomaly
    f = N.isolation_forest(d, ["age", "amount"], "user_id")
    assert f.orderBy(F.desc("score")).first().key == 40
    assert sorted(f.collect()) == sorted(N.isolation_forest(d.repartition(5), ["age", "amount"], "user_id").collect())


def test_missingness_classes(spark):
    rows = [(("ER" if i % 2 else "Scheduled"), None if (i % 2 and i % 10 < 6) else 1.0, None if i % 8 == 0 else 2.0) for i in range(400)]
    d = spark.createDataFrame(rows, "visit string, score double, noise double")
    got = by(L.missingness_drivers(d), "column", "classification", "driver")
    assert got["score"] == ("MAR", "visit")


def test_equity_disparity(spark):
    g = spark.createDataFrame([("a", 100, 0.06), ("b", 100, 0.14), ("c", 3, 0.9)], "group string, n long, value double")
    got = by(L.disparity(g), "group", "status")
    assert got == {"a": ("fail",), "b": ("warn",)}


def test_chain_merkle_and_blame(spark):
    log = spark.createDataFrame([], "dataset string, step long, op string, description string, content string, parent_hash string, hash string")
    for i in range(4):
        log = spark.createDataFrame(log.unionByName(H.append_step(log, "d", "op", f"s{i}")).collect(), log.schema)
    assert H.verify_chains(log).first().valid
    bad = log.withColumn("description", F.when(F.col("step") == 2, "changed").otherwise(F.col("description")))
    assert H.verify_chains(bad).first().broken_at == 2
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n in (1, 2, 5, 256, 257, 700):
        leaves = [sha(str(i)) for i in range(n)]
        level = leaves
        while len(level) > 1:
            level = [sha("N:" + level[i] + (level[i + 1] if i + 1 < len(level) else level[i])) for i in range(0, len(level), 2)]
        df = spark.createDataFrame(list(enumerate(leaves)), "i long, h string").repartition(5)
        assert H.merkle_root(df, "h", "i", "i").first().root == level[0]


def test_privacy(spark):
    d = spark.createDataFrame([("x",)] * 90 + [("rare",)] * 3, "c string")
    f = P.shareable_fingerprint(d, ["c"], epsilon=None)
    assert {r.bin for r in f.collect()} == {"x", "(rare)"}
    a = P.noised_counts(d, "c", 1.0, "one").collect()
    assert sorted(a) == sorted(P.noised_counts(d.repartition(4), "c", 1.0, "one").collect())
    assert sorted(a) != sorted(P.noised_counts(d, "c", 1.0, "two").collect())
    with pytest.raises(ValueError):
        P.noised_counts(d, "c", 1.0, "")
    with pytest.raises(ValueError):
        P.noised_counts(d, "c", 0, "one")
    s = P.synthetic_rows(spark.range(500).select((F.col("id") * 1.0).alias("v")), ["v"], 400, "one")
    assert s.count() == 400 and 180 < s.agg(F.avg("v")).first()[0] < 320


def test_injected_defects_are_found(spark):
    d = spark.range(2000).select("id", (F.col("id") % 50 + 1.0).alias("amount"), F.lit("ok").alias("status"))
    out, m = C.inject_defects(d, "id", {"amount": 0.05}, {"amount": 0.02}, {"status": 0.1}, 0.03)
    n = by(m, "kind", "count")
    assert out.count() == 2000 + n["duplicate"][0]
    assert A.duplicate_rows(out).first().extra_rows == n["duplicate"][0]
    assert out.dropDuplicates().where("status = 'ok_drift'").count() == n["drift"][0]


def test_redaction_and_names(spark):
    d = spark.createDataFrame([("call 123-45-6789 or a@b.org, MRN: 55512345 id 1234567890", "f")], "note string, gender string")
    r = Q.redact(d)
    assert r.columns == ["note"]
    assert r.first().note == "call [REDACTED:SSN] or [REDACTED:EMAIL], [REDACTED:MRN] id [REDACTED:ID]"
    assert Q.clean_name("01_patient-firstName_2") == "Patient First Name"
    assert Q.expand_metrics("select @a, @zz", {"a": "sum(x)"}) == "select (sum(x)), @zz"


def test_gap_break_and_simpson(spark):
    rows = [(i, "A", 10.0) for i in range(30)] + [(100 + i, "B", 9.0) for i in range(30)] + [(999, "A", 400.0)]
    d = spark.createDataFrame(rows, "k int, g string, v double")
    r = S.rows_to_break_gap(d, "v", "g", "A", "B", "k").first()
    assert (r.rows_to_break, r.mode, r.severity) == (1, "disappears", "fragile")
    seg = [("s1", "A", 1.0)] * 9 + [("s1", "B", 2.0)] + [("s2", "A", 8.0)] + [("s2", "B", 9.0)] * 9
    p = S.simpson_check(spark.createDataFrame(seg, "s string, g string, v double"), "v", "g", "s", "A", "B")
    assert not any(r.reversed for r in p.collect())


def test_safe_cast_keeps_raw(spark):
    d = spark.createDataFrame([("12abc",), ("x",), ("",), (None,), ("-3.5",)], "c string")
    got = [(r.c, r.c_raw) for r in Q.safe_cast(d, "c", "number").collect()]
    assert got == [(12.0, None), (None, "x"), (None, None), (None, None), (-3.5, None)]


def test_similar_key_names():
    assert J.suggest_keys_by_name(["a", "Cust_Id"], ["cust_id"]) == ("Cust_Id", "cust_id", "high")
    assert J.suggest_keys_by_name(["order_id"], ["id"])[2] == "medium"
    assert J.suggest_keys_by_name(["zip code"], ["zip_code"]) == ("zip code", "zip_code", "medium")
    assert J.suggest_keys_by_name(["a"], ["b"]) is None
