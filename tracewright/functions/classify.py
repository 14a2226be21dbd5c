"""Rule-based classes as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import blank_to_null, col, contains_any, first_match, lookup
from tracewright.functions.text import first_label, squeeze


def norm_app(c, mode: str = "keyword") -> Column:
    """Application name (F08): by ``keyword``, by ``exact`` map, or to a ``tool`` class."""
    text = squeeze(F.coalesce(col(c), F.lit("")))
    low = F.lower(text)
    if mode == "keyword":
        cases = [(low == "", "UNKNOWN_APP")]
        cases += [(F.rlike(low, F.lit("|".join(words))), name) for words, name in vocab.APP_KEYWORDS]
        return first_match(cases, text)
    if mode == "exact":
        return lookup(low, vocab.APP_EXACT, default=text)
    if mode == "tool":
        return first_match([(contains_any(low, words), name) for words, name in vocab.TOOL_KEYWORDS],
                           "OtherTool")
    raise ValueError(f"unknown mode {mode!r}")


def duration_bucket(c, edges: Sequence[float] = vocab.DURATION_EDGES,
                    names: Sequence[str] = vocab.DURATION_NAMES) -> Column:
    """Left-closed buckets."""
    d = col(c).cast("double")
    cases = [(d.isNull(), "UNKNOWN")]
    cases += [(d < float(e), n) for e, n in zip(edges, names)]
    return first_match(cases, names[-1])


def app_variant(c) -> Column:
    """word > notepad > excel > browser."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return first_match([(F.contains(text, F.lit("word")), "word"),
                        (F.contains(text, F.lit("notepad")), "notepad"),
                        (F.contains(text, F.lit("excel")), "excel")], "browser")


def document_patterns(apps, windows) -> Column:
    """Sorted document kinds hinted at by applications and window titles."""
    text = F.lower(F.concat(F.coalesce(col(apps), F.lit("")), F.lit(" | "), F.coalesce(col(windows), F.lit(""))))
    return F.array_compact(F.array(
        F.when(contains_any(text, ("excel", ".xls")), F.lit("Excel/spreadsheet")),
        F.when(contains_any(text, ("notepad", ".txt")), F.lit("Notepad/text")),
        F.when(contains_any(text, ("word", ".doc")), F.lit("Word/document"))))


def page_of(path) -> Column:
    low = F.lower(col(path))
    return first_match([(F.contains(low, F.lit("payroll-items")), "PAYROLL_ITEMS"),
                        (F.contains(low, F.lit("leave-applications")), "LEAVE_APPLICATIONS"),
                        (contains_any(low, ("employee", "staff")), "EMPLOYEE")], "OTHER_WEB_PAGE")


def page_class(classes) -> Column:
    """Class of a segment from the set of its page classes."""
    c = col(classes)
    return first_match([(F.size(c) == 0, "NO_PAGE"), (F.size(c) == 1, F.try_element_at(c, F.lit(1)))],
                       "MULTI_PAGE")


def transfer_class(clipboard, form, navigation, cross_app) -> Column:
    """How data moves in a segment."""
    clip, form, nav, cross = col(clipboard) > 0, col(form) > 0, col(navigation) > 0, col(cross_app)
    return first_match([(clip & form & cross, "CROSS_APP_DATA_TRANSFER"),
                        (clip & cross, "CROSS_APP_CLIPBOARD"),
                        (form, "FORM_INTERACTION"), (nav, "NAVIGATION"),
                        (cross, "CROSS_APP_OTHER")], "SINGLE_APP_ACTIVITY")


def family_signature(apps, app_count, page, transfer, duration) -> Column:
    """Coarse process-family signature from the set of applications."""
    a = col(apps)

    def both(name):
        return F.array_contains(a, "Microsoft Edge") & F.array_contains(a, name)

    shape = first_match([(both("Microsoft Word"), "EDGE_WORD_WORKFLOW"),
                         (both("Notepad"), "EDGE_NOTEPAD_WORKFLOW"),
                         (both("Microsoft Excel"), "EDGE_EXCEL_WORKFLOW"),
                         (col(app_count) >= 2, "OTHER_CROSS_APP")], "EDGE_ONLY_OR_SINGLE_APP")
    return F.concat_ws(" | ", shape, col(page), col(transfer), col(duration))


def action_class(event_type, app, routes=None, documents=None, dom=None) -> Column:
    """Observable action class of an event."""
    et = F.lower(F.coalesce(col(event_type), F.lit("")))
    a = norm_app(app)
    context = [(blank_to_null(c).isNotNull(), name) for c, name in (
        (routes, "BROWSER_CONTEXT"), (documents, "DOCUMENT_CONTEXT"), (dom, "UI_CONTEXT")) if c is not None]
    work = [(a.isin("Browser", "Word", "Excel", "Notepad"), F.concat(F.lit("WORK_"), F.upper(a)))]
    other = first_match([(et == "keystroke", lookup(a, vocab.KEYSTROKE_BY_APP, F.lit("TYPE"))), *context, *work],
                        "OTHER_EVENT")
    # one map probe instead of a branch per type keeps the generated code small
    return lookup(et, vocab.ACTION_BY_TYPE, other)


def action_family(action) -> Column:
    """Family of an action class."""
    return lookup(action, vocab.ACTION_FAMILY)


def phase_class(token) -> Column:
    """Clean phase of a raw phase token such as ``TRANSFER[Excel]``."""
    return lookup(F.substring_index(F.trim(col(token)), "[", 1), vocab.CLEAN_PHASE)


def workflow_signature(routes, apps, phases, clip, form, nav) -> Column:
    """Structural signature of a segment."""
    def flag(c):
        return col(c).cast("boolean").cast("int").cast("string")

    return F.concat(F.coalesce(blank_to_null(routes), F.lit("UNKNOWN_ROUTE")),
                    F.lit(" || apps="), F.coalesce(blank_to_null(apps), F.lit("UNKNOWN_APP")),
                    F.lit(" || phases="), F.coalesce(blank_to_null(phases), F.lit("UNKNOWN_PHASE")),
                    F.lit(" || clip="), flag(clip), F.lit(" || form="), flag(form),
                    F.lit(" || nav="), flag(nav))


def event_weight(c) -> Column:
    """Information weight of an event type."""
    return first_match([(col(c).isin(*vocab.HIGH_INFORMATION_EVENTS), 5.0),
                        (col(c).isin(*vocab.MEDIUM_INFORMATION_EVENTS), 2.0)], 0.0)


def item_score(transition_distance, event_distance, event_type, position, near: float = 1.5) -> Column:
    """Score of an item in a segment (F31): +12 near a transition, the weight of a near
    event, +0.5 in the early, middle or late part."""
    td, ed, pos = col(transition_distance), col(event_distance), col(position)
    edge = pos.between(0.0, 0.2) | pos.between(0.4, 0.6) | pos.between(0.8, 1.0)
    return (F.lit(1.0) + F.when(td <= near, 12.0).otherwise(0.0)
            + F.when(ed <= near, event_weight(event_type)).otherwise(0.0)
            + F.when(edge, 0.5).otherwise(0.0))


def text_flags(c, rules: Mapping[str, str] | None = None) -> list[Column]:
    """Named regex flags on a text."""
    rules = rules or {"decision_context": vocab.DECISION_TEXT,
                      "policy_exception_context": vocab.POLICY_TEXT}
    text = F.coalesce(col(c), F.lit(""))
    return [F.rlike(text, F.lit(p)).alias(name) for name, p in rules.items()]


def phase_treatment(phase) -> Column:
    """Automation treatment of a phase from its own mechanical nature."""
    p = col(phase)
    return first_match([
        (p.isin("BROWSER_NAVIGATION", "BROWSER_WORK", "DATA_TRANSFER", "FORM_ENTRY", "DOCUMENT_WORK"),
         "AUTOMATE + FLAG"),
        (p == "APPLICATION_SWITCH", "AUTOMATE")], "UNKNOWN / VALIDATE")


def mechanical_fit(mechanical, decision, clipboard) -> Column:
    """Automation fit from evidence percentages."""
    m, d, c = col(mechanical), col(decision), col(clipboard)
    return first_match([((m >= 90) & (d < 20) & (c >= 80), "STRONG_MECHANICAL_FIT"),
                        ((m >= 80) & (c >= 50), "GOOD_MECHANICAL_FIT_WITH_HUMAN_STEP")],
                       "PARTIAL_AUTOMATION_CANDIDATE")


def risk_levels(family, decision, clipboard, app_count, data_risk) -> dict[str, Column]:
    """Risk levels, their points and the feasibility they imply."""
    d, c, n = col(decision), col(clipboard), col(app_count)
    human = first_match([(d >= 30, "HIGH"), (d >= 15, "MEDIUM")], "LOW-MEDIUM")
    selector = first_match([(col(family) != "other", "MEDIUM")], "HIGH / UNKNOWN")
    cross = first_match([((n >= 3) | (c >= 80), "HIGH"), (n >= 2, "MEDIUM")], "LOW-MEDIUM")

    def three(level):
        return first_match([(level == "HIGH", 2), (level == "MEDIUM", 1)], 0)

    points = (three(human) + three(cross) + first_match([(F.startswith(selector, F.lit("HIGH")), 2)], 1)
              + first_match([(col(data_risk) == "HIGH", 2)], 1))
    feasibility = first_match([(points >= 7, "PILOT-FIRST"), (points >= 5, "FEASIBLE_WITH_VALIDATION")],
                              "LOWER_RISK")
    return {"human_risk": human, "selector_risk": selector, "cross_app_risk": cross,
            "risk_points": points, "feasibility": feasibility}


def priority_tier(family, time_share, mechanical, clipboard, ui_risk, cross_risk, governance) -> Column:
    """Qualitative priority, first rule that fits."""
    f, t, m, c = col(family), col(time_share), col(mechanical), col(clipboard)
    ui, cross, gov = col(ui_risk), col(cross_risk), col(governance)
    acceptable = (ui == "MEDIUM") & cross.isin("MEDIUM", "LOW-MEDIUM")
    return first_match([
        (f == "other", "P3 — DEFER / SUPPORT ONLY"),
        ((f == "pi") & (t >= 30) & (m >= 95) & (c >= 80), "P1 — PRIMARY CANDIDATE"),
        ((t >= 20) & (m >= 95) & (c >= 85), "P2 — STRONG SECOND"),
        ((t >= 10) & (m >= 95) & (c >= 90) & acceptable, "P2 — GOOD CANDIDATE"),
        ((gov == "HIGH") | F.startswith(ui, F.lit("HIGH")) | (cross == "HIGH"), "P3 — PILOT / VALIDATE"),
    ], "P3 — LIMITED / PILOT")


def replay_class(exception, human_gate, target, raw_events, source, transform, variants) -> Column:
    """Replay class of a segment, first rule that fits."""
    return first_match([
        (col(exception), "EXCEPTION"), (col(human_gate) & col(target), "HUMAN_GATE"),
        (col(raw_events) == 0, "INSUFFICIENT_RAW_EVIDENCE"), (~col(source), "STRUCTURAL_ONLY"),
        (~col(target), "INSUFFICIENT_TARGET_EVIDENCE"), (~col(transform), "TRANSFORM_REVIEW"),
        (F.size(col(variants)) > 0, "REPLAYABLE_WITH_VARIANT")], "REPLAYABLE")


def case_type(c) -> Column:
    return first_label(c, vocab.CASE_RULES, "OTHER_OR_UNRESOLVED")


def validate_record(employee, case, amount, date, supported: Sequence[str] = vocab.SUPPORTED_CASES,
                    allow_negative: bool = False) -> dict[str, Column]:
    """Check a request record and give its canonical form."""
    emp, kind = F.trim(F.coalesce(col(employee), F.lit(""))), col(case)
    money = F.replace(F.trim(F.coalesce(col(amount), F.lit(""))), F.lit(","), F.lit(""))
    when = F.coalesce(col(date), F.lit(""))
    exact = money.try_cast("decimal(18,2)")
    checks = [
        (emp == "", "STOP_MISSING_REQUIRED_INPUT", "missing employee_id"),
        (~F.coalesce(kind.isin(*supported), F.lit(False)), "STOP_UNSUPPORTED_REQUEST_TYPE",
         "unsupported request type"),
        (~F.rlike(money, F.lit(r"^-?\d+(?:\.\d{1,2})?$")), "STOP_INVALID_INPUT", "amount is not numeric"),
    ]
    if not allow_negative:
        checks.append((F.startswith(money, F.lit("-")) & (exact < 0), "STOP_INVALID_INPUT", "negative amount"))
    checks.append((~F.rlike(when, F.lit(r"^\d{4}-\d{2}-\d{2}$")), "STOP_INVALID_INPUT", "invalid date"))
    code = first_match([(c, k) for c, k, _ in checks], "VALID")
    ok = code == "VALID"
    return {"ok": ok, "code": code, "reason": first_match([(c, r) for c, _, r in checks], ""),
            "amount_2dp": F.when(ok, exact), "effective_date_iso": F.when(ok, F.trim(when))}
