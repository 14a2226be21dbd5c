"""Semantic records and family lists against hand-made answers."""


from tracewright.operators import semantics as sem


def test_record_of_texts(spark):
    texts = ["経費精算 保留 社員番号 金額", "Payroll change: APPROVED, save in Word document", "nothing to see", "", None, "hold the leave application"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r for r in sem.semantic_record(df, "t").collect()}
    assert got[0]["request"] == ["EXPENSE_REIMBURSEMENT"] and got[0]["field"] == ["EMPLOYEE_ID", "AMOUNT"] and got[0]["status"] == ["HOLD"]
    assert got[0]["case"] == ["EXPENSE_REIMBURSEMENT"] and got[0]["object"] == "EMPLOYEE_RECORD" and got[0]["human_gate"]
    assert got[1]["request"] == ["PAYROLL_CHANGE"] and got[1]["status"] == ["APPROVAL"] and got[1]["instruction"] == ["SAVE"]
    assert got[1]["document"] == ["WORD_OR_DOCUMENT"] and got[1]["decision"] == ["APPROVE"] and not got[1]["human_gate"]
    for i in (2, 3, 4):
        assert not got[i]["labels"] and got[i]["object"] == "" and not got[i]["human_gate"]
    assert got[5]["decision"] == ["HOLD"] and got[5]["object"] == "EMPLOYEE_APPLICATION_OR_REQUEST"


def test_lists_of_families(spark):
    rows = [("a", "s1", 1, 0.5, "status hold", "/x", "W"), ("a", "s1", 1, 1.0, "status", "/x", None), ("a", "s2", 1, None, "amount", "/y", "W"),
            ("b", "s1", 2, 0.2, None, None, ""), (None, "s9", 9, 1.0, "status", "/z", "W")]
    df = spark.createDataFrame(rows, "f string, s string, g long, p double, t string, r string, v string")
    made = sem.semantic_lists(sem.semantic_record(df, "t"), "f", "s", "g", "p", "labels", {"fields": ["field"], "actions": ["action", "status"]}, {"routes": "r", "variants": "v"}, k=1)
    got = {r["f"]: tuple(r)[1:] for r in made.collect()}
    assert got == {"a": (3, 2, 2, 0.75, "STATUS (2)", "HOLD (1)", "/x (2)", "W (2)"), "b": (1, 1, 1, 0.2, "", "", "", ""),
                   None: (4, 3, 2, (0.5 + 1.0 + 0.2) / 3, "STATUS (2)", "HOLD (1)", "/x (2)", "W (2)")}
    empty = sem.semantic_lists(sem.semantic_record(df.limit(0), "t"), "f", "s", "g", "p", "labels", {"fields": ["field"]}, {"routes": "r"}, k=1)
    assert empty.collect() == []
