"""Hand-computed values of the Column functions."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions import classify as cl
from tracewright.functions import columns as co
from tracewright.functions import scores as sc
from tracewright.functions import text as tx


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn("c").alias("r")).first()["r"]


@pytest.mark.parametrize("fn,value,want", [
    (tx.mask_ids, "Emp E12345 on 2024-01-31 at 9:05  ref AB-123456", "emp {id} on {date} at {time} ref {id}"),
    (tx.norm_token, "  File E0012  1234567 ", "file {id} {n}"),
    (tx.coarsen_title, "Pay_roll-List - Notepad (2)", "pay roll list"),
    (tx.coarsen_title, "procmine-desktop-agent settings", ""),
    (tx.norm_url_path, "https://h.x/a/12345/deadbeef01//b?q=1", "/a/{id}/{id}/b"),
    (tx.norm_url_path, "", ""),
    (tx.hash_route, "https://h/#/payroll-items/?id=3", "payroll-items"),
    (tx.route, "C:\\shots\\scr_1.png", "UNKNOWN_ROUTE"),
    (tx.route, "https://h/#/resident-tax/4", "/resident-tax"),
    (tx.url_domain, "https://www.Example.com:8443/x", "example.com"),
    (tx.field_token, "name = Due  Date", "field:name:due_date"),
    (tx.canonical_field, "社員番号", "employee_id"),
])
def test_text(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_lists_and_tokens(spark):
    assert one(spark, "('a', 'b ')", lambda c: tx.parse_list(c, "literal")) == ["a", "b"]
    assert one(spark, "()", lambda c: tx.parse_list(c, "literal")) == []
    assert one(spark, "a | |b", tx.parse_list) == ["a", "b"]
    assert one(spark, "click=3 | note=x | click=5", lambda c: tx.parse_list(c, "counter")) == {"click": 5}
    assert one(spark, "Pay 給与変更 pay", tx.token_set) == ["pay", "給与変更"]
    assert set(one(spark, "EMP-42 2024-01-05 1,200.50", tx.concrete_tokens)) >= {"emp-42", "2024-01-05", "1,200.50"}
    assert one(spark, "金額 amount\nabc\n氏名", tx.script_lines) == ["金額 amount", "氏名"]
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(tx.set_jaccard("x", "y")).collect()] == [1.0, 0.0, 0.5]


@pytest.mark.parametrize("value,plain,buttons", [("pi-note", ["pi", "pi"], ["pi", "pi"]), ("btn-la-ok", [], ["la", "la"]), ("xx-note", [], [])])
def test_prefix_evidence(spark, value, plain, buttons):
    assert one(spark, value, lambda c: tx.prefix_hits(F.lit("id"), c)) == plain
    assert one(spark, value, lambda c: tx.prefix_hits(F.lit("id"), c, buttons=True)) == buttons


def test_event_time(spark):
    df = spark.createDataFrame([("1700000000000", None), ("1700000000", None), ("bad", "2023-11-14T22:13:20Z"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(F.unix_seconds(co.event_time("a", "b"))).collect()]
    assert got == [1700000000] * 3 + [None]


@pytest.mark.parametrize("seconds,want", [(0.0, "<10s"), (9.99, "<10s"), (10.0, "10-20s"), (299.0, "2-5m"), (300.0, "5m+"), (None, "UNKNOWN")])
def test_duration_bucket(spark, seconds, want):
    assert one(spark, seconds, cl.duration_bucket, "double") == want


def test_apps_and_actions(spark):
    assert one(spark, "msedge.exe", lambda c: cl.norm_app(c, "exact")) == "Microsoft Edge"
    assert one(spark, "Google  Chrome", cl.norm_app) == "Browser"
    assert one(spark, "", cl.norm_app) == "UNKNOWN_APP"
    df = spark.createDataFrame([("keystroke", "WINWORD"), ("keystroke", "Foo"), ("app_switch", "x"), ("odd", "Excel"), ("odd", "Foo")], "e string, a string")
    assert [r[0] for r in df.select(cl.action_class("e", "a")).collect()] == ["EDIT_WORD", "TYPE", "SWITCH_APPLICATION", "WORK_EXCEL", "OTHER_EVENT"]


# the published scenarios: normal, blank id, unsupported, bad amount, negative, bad date
@pytest.mark.parametrize("rec,code,amount", [
    (("E1", "payroll_change", "1,200.5", "2024-05-01"), "VALID", 1200.5),
    ((" ", "payroll_change", "1", "2024-05-01"), "STOP_MISSING_REQUIRED_INPUT", None),
    (("E1", "holiday", "1", "2024-05-01"), "STOP_UNSUPPORTED_REQUEST_TYPE", None),
    (("E1", "payroll_change", "abc", "2024-05-01"), "STOP_INVALID_INPUT", None),
    (("E1", "payroll_change", "-3", "2024-05-01"), "STOP_INVALID_INPUT", None),
    (("E1", "payroll_change", "3", "01/05/2024"), "STOP_INVALID_INPUT", None),
])
def test_validate_record(spark, rec, code, amount):
    df = spark.createDataFrame([rec], "e string, k string, a string, d string")
    r = df.select(*[c.alias(n) for n, c in cl.validate_record("e", "k", "a", "d").items()]).first()
    assert r["code"] == code and r["ok"] == (code == "VALID")
    assert (None if r["amount_2dp"] is None else float(r["amount_2dp"])) == amount


def test_rules(spark):
    df = spark.createDataFrame([(96.0, 31.0, 85.0, 3), (85.0, 10.0, 60.0, 1)], "m double, d double, c double, n int")
    got = df.select(cl.mechanical_fit("m", "d", "c").alias("fit"), *[c.alias(k) for k, c in cl.risk_levels(F.lit("pi"), "d", "c", "n", F.lit("HIGH")).items()]).collect()
    assert (got[0]["fit"], got[0]["risk_points"], got[0]["feasibility"]) == ("GOOD_MECHANICAL_FIT_WITH_HUMAN_STEP", 7, "PILOT-FIRST")
    assert (got[1]["human_risk"], got[1]["risk_points"], got[1]["feasibility"]) == ("LOW-MEDIUM", 3, "LOWER_RISK")
    tier = spark.range(1).select(cl.priority_tier(F.lit("pi"), F.lit(35.8), F.lit(100.0), F.lit(82.0), F.lit("MEDIUM"), F.lit("HIGH"), F.lit("MEDIUM"))).first()[0]
    assert tier == "P1 — PRIMARY CANDIDATE"


def test_replay_class_order(spark):
    cols = "x boolean, g boolean, t boolean, n int, s boolean, f boolean, v array<string>"
    cases = [((True, True, True, 1, True, True, []), "EXCEPTION"), ((False, True, True, 1, False, True, []), "HUMAN_GATE"),
             ((False, True, False, 0, False, True, []), "INSUFFICIENT_RAW_EVIDENCE"), ((False, False, True, 1, False, True, []), "STRUCTURAL_ONLY"),
             ((False, False, True, 1, True, False, []), "TRANSFORM_REVIEW"), ((False, False, True, 1, True, True, ["DOCUMENT"]), "REPLAYABLE_WITH_VARIANT"),
             ((False, False, True, 1, True, True, []), "REPLAYABLE")]
    df = spark.createDataFrame([c for c, _ in cases], cols)
    assert [r[0] for r in df.select(cl.replay_class("x", "g", "t", "n", "s", "f", "v")).collect()] == [w for _, w in cases]


def test_scores(spark):
    df = spark.createDataFrame([(0.0, "LOW"), (2.0, "MEDIUM"), (4.0, "HIGH"), (6.0, "VERY_HIGH")], "s double, w string")
    assert all(r[0] == r[1] for r in df.select(sc.review_priority("s"), "w").collect())
    r = spark.range(1).select(*co.prf(F.lit(0), F.lit(0), F.lit(3))).first()
    assert tuple(r) == (0.0, 0.0, 0.0)
    assert one(spark, "browser_click", cl.event_weight) == 5.0 and one(spark, "keystroke", cl.event_weight) == 2.0
    flags = one(spark, "要確認 and approval", lambda c: F.struct(*cl.text_flags(c)))
    assert (flags["decision_context"], flags["policy_exception_context"]) == (True, True)
    assert one(spark, "登録確定 保留", lambda c: tx.regex_labels(c, vocab.DECISION_RULES)) == ["CONFIRM_OR_FINALIZE", "HOLD"]
