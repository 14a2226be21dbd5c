"""These must equal the published rules for results to agree."""

# --- event vocabulary -------------------------------------------------------
EVENT_CLASSES: dict[str, tuple[str, ...]] = {
    "keyboard": ("keystroke", "text_input_complete"),
    "keystroke": ("keystroke",),
    "window_change": ("window_title_change", "window_state_change"),
    "window_title": ("window_title_change",),
    "app_switch": ("app_switch",),
    "navigation": ("browser_navigation",),
    "browser_click": ("browser_click",),
    "browser_form": ("browser_form_input",),
    "mouse_click": ("mouse_click",),
    "mouse_scroll": ("mouse_scroll",),
    "clipboard": ("clipboard_change",),
    "shortcut": ("shortcut",),
    "screenshot": ("screenshot_smart",),
    "browser": ("browser_navigation", "browser_click", "browser_form_input", "browser_error",
                "browser_alert", "browser_tab_event"),
    "desktop": ("app_switch", "window_title_change", "window_state_change", "mouse_click",
                "mouse_scroll", "mouse_double_click", "mouse_drag_drop", "keystroke", "shortcut",
                "text_input_complete", "clipboard_change"),
}
HIGH_INFORMATION_EVENTS = (
    "app_switch", "browser_navigation", "browser_form_input", "browser_click", "clipboard_change",
    "mouse_click", "shortcut", "text_input_complete", "window_title_change", "window_state_change",
    "dialog_opened", "dialog_closed", "upload_started", "upload_completed",
)
MEDIUM_INFORMATION_EVENTS = ("keystroke", "mouse_scroll", "browser_alert", "browser_tab_event")

# --- boundary features and scores ------------------------------------------
WINDOW_COUNTS = ("event_count", "app_switches", "navigation", "browser_clicks", "mouse_clicks",
                 "window_changes", "unique_apps", "keyboard")
FEATURE_COLUMNS = tuple(f"{side}_{name}" for name in WINDOW_COUNTS for side in ("before", "after"))
BIN_WEIGHTS = {"app_switches": 1.0, "navigation": 1.0, "browser_clicks": 0.5,
               "mouse_clicks": 0.5, "window_changes": 0.25}
CHANGE_WEIGHTS = {"app_switches": 0.75, "navigation": 0.75, "browser_clicks": 0.25,
                  "mouse_clicks": 0.25, "window_changes": 0.25, "unique_apps": 0.5,
                  "unique_urls": 0.5, "keyboard": 0.1}

# --- leakage audit ----------------------------------------------------------
LEAKAGE_EXACT = ("process_code", "process_name", "process_variant", "current_process", "case_id",
                 "gt_ts", "boundary_ts", "boundary_event", "boundary_from", "boundary_to", "label")
LEAKAGE_TOKENS = ("ground_truth", "gt_boundary", "process_code", "process_name",
                  "current_process", "case_id")

# --- segment labels ----------------------------------------------------------
PREFIXES = ("pi", "la", "ob", "si", "rt")
PREFIX_EVENT_TYPES = ("browser_click", "browser_form_input", "keystroke")
KNOWN_ROUTES = ("/payroll-items", "/leave-applications", "/onboarding", "/social-insurance",
                "/resident-tax")
ROUTE_NOISE = (".png", ".jpg", ".jpeg", ".webp", "screenshot", "scr_smart", "monitor_",
               "\\", "c:/", "d:/")
JSON_NOISE_KEY = (r"(?i)(event_id|session_id|sequence_number|chunk_id|timestamp|hash|sha|version|"
                  r"monitor|screen|resolution|latency|http_status|process_id|pid|browser_version)$")

# --- applications -------------------------------------------------------------
APP_KEYWORDS = (
    (("edge", "chrome", "firefox", "browser"), "Browser"), (("word",), "Word"),
    (("excel",), "Excel"), (("notepad",), "Notepad"), (("openwith",), "OpenWith"),
    (("explorer",), "Explorer"), (("terminal", "powershell", "cmd"), "Terminal"),
)
TOOL_KEYWORDS = (
    (("browser", "edge", "chrome", "firefox"), "Browser"),
    (("word", "excel", "notepad"), "DocumentTool"), (("explorer", "openwith"), "FileTool"),
)
APP_EXACT = {
    "microsoft edge": "Microsoft Edge", "msedge.exe": "Microsoft Edge", "msedge": "Microsoft Edge",
    "microsoft word": "Microsoft Word", "winword.exe": "Microsoft Word", "winword": "Microsoft Word",
    "microsoft excel": "Microsoft Excel", "excel.exe": "Microsoft Excel", "excel": "Microsoft Excel",
    "notepad": "Notepad", "notepad.exe": "Notepad",
    "microsoft teams": "Microsoft Teams", "ms-teams": "Microsoft Teams", "ms-teams.exe": "Microsoft Teams",
    "windows explorer": "Windows Explorer", "explorer.exe": "Windows Explorer",
    "explorer": "Windows Explorer",
    "windowsterminal": "Windows Terminal", "windowsterminal.exe": "Windows Terminal",
    "powershell": "PowerShell", "powershell.exe": "PowerShell",
    "procmine-desktop-agent": "ProcMine Agent", "procmine-desktop-agent.exe": "ProcMine Agent",
}
IMPORTANT_TRANSITIONS = (
    ("Microsoft Edge", "Notepad"), ("Notepad", "Microsoft Edge"),
    ("Microsoft Edge", "Microsoft Word"), ("Microsoft Word", "Microsoft Edge"),
    ("Microsoft Edge", "Microsoft Excel"), ("Microsoft Excel", "Microsoft Edge"),
)

# --- durations ----------------------------------------------------------------
DURATION_EDGES = (10, 20, 40, 60, 120, 300)
DURATION_NAMES = ("<10s", "10-20s", "20-40s", "40-60s", "1-2m", "2-5m", "5m+")
COMPLEXITY = {"app_count": 3, "transition_count": 2, "page_count": 2, "event_count": 75}

# --- actions and phases ---------------------------------------------------------
ACTION_BY_TYPE = {
    "app_switch": "SWITCH_APPLICATION", "browser_navigation": "NAVIGATE_BROWSER",
    "browser_form_input": "ENTER_BROWSER_FORM", "browser_click": "CLICK_BROWSER",
    "clipboard_change": "CLIPBOARD_TRANSFER", "shortcut": "COPY_EDIT_SHORTCUT",
    "text_input_complete": "TEXT_INPUT_COMPLETE", "mouse_click": "CLICK_DESKTOP",
    "mouse_scroll": "SCROLL", "window_title_change": "WINDOW_CHANGE",
    "screenshot_smart": "SCREENSHOT_CHECKPOINT",
}
KEYSTROKE_BY_APP = {"Word": "EDIT_WORD", "Excel": "EDIT_EXCEL", "Notepad": "EDIT_NOTEPAD",
                    "Browser": "TYPE_BROWSER"}
ACTION_FAMILY = {
    "SCREENSHOT_CHECKPOINT": "EVIDENCE", "WINDOW_CHANGE": "CONTEXT", "UI_CONTEXT": "CONTEXT",
    "BROWSER_CONTEXT": "BROWSER", "WORK_BROWSER": "BROWSER", "CLICK_BROWSER": "BROWSER",
    "NAVIGATE_BROWSER": "BROWSER", "ENTER_BROWSER_FORM": "BROWSER_FORM",
    "TYPE_BROWSER": "BROWSER_FORM", "TEXT_INPUT_COMPLETE": "BROWSER_FORM",
    "WORK_WORD": "DOCUMENT", "EDIT_WORD": "DOCUMENT", "WORK_EXCEL": "DOCUMENT",
    "EDIT_EXCEL": "DOCUMENT", "WORK_NOTEPAD": "DOCUMENT", "EDIT_NOTEPAD": "DOCUMENT",
    "TYPE": "DESKTOP_INPUT", "CLICK_DESKTOP": "DESKTOP_INPUT", "SCROLL": "DESKTOP_INPUT",
    "COPY_EDIT_SHORTCUT": "TRANSFER", "CLIPBOARD_TRANSFER": "TRANSFER",
    "SWITCH_APPLICATION": "APP_TRANSITION", "OTHER_EVENT": "OTHER",
}
CLEAN_PHASE = {
    "NAVIGATE_BROWSER": "BROWSER_NAVIGATION", "BROWSER_CONTEXT": "BROWSER_WORK",
    "WORK_BROWSER": "BROWSER_WORK", "CLICK_BROWSER": "BROWSER_WORK", "BROWSER": "BROWSER_WORK",
    "ENTER_BROWSER_FORM": "FORM_ENTRY", "TYPE_BROWSER": "FORM_ENTRY",
    "TEXT_INPUT_COMPLETE": "FORM_ENTRY", "BROWSER_FORM": "FORM_ENTRY",
    "CLIPBOARD_TRANSFER": "DATA_TRANSFER", "COPY_EDIT_SHORTCUT": "DATA_TRANSFER",
    "TRANSFER": "DATA_TRANSFER",
    "WORK_WORD": "DOCUMENT_WORK", "EDIT_WORD": "DOCUMENT_WORK", "WORK_EXCEL": "DOCUMENT_WORK",
    "EDIT_EXCEL": "DOCUMENT_WORK", "WORK_NOTEPAD": "DOCUMENT_WORK", "EDIT_NOTEPAD": "DOCUMENT_WORK",
    "DOCUMENT": "DOCUMENT_WORK", "DOCUMENT_CONTEXT": "DOCUMENT_WORK",
    "SWITCH_APPLICATION": "APPLICATION_SWITCH", "APP_TRANSITION": "APPLICATION_SWITCH",
    "CLICK_DESKTOP": "DESKTOP_INPUT", "TYPE": "DESKTOP_INPUT", "SCROLL": "DESKTOP_INPUT",
    "DESKTOP_INPUT": "DESKTOP_INPUT",
    "WINDOW_CHANGE": "CONTEXT", "UI_CONTEXT": "CONTEXT", "CONTEXT": "CONTEXT",
    "SCREENSHOT_CHECKPOINT": "EVIDENCE", "EVIDENCE": "EVIDENCE",
}
PHASE_ALIASES = {
    "BROWSER": "BROWSER_WORK", "BROWSER_WORK": "BROWSER_WORK",
    "BROWSER_NAVIGATION": "BROWSER_NAVIGATION", "FORM_ENTRY": "FORM_ENTRY",
    "DATA_TRANSFER": "DATA_TRANSFER", "DOCUMENT_WORK": "DOCUMENT_WORK",
    "APPLICATION_SWITCH": "APPLICATION_SWITCH", "APP_TRANSITION": "APPLICATION_SWITCH",
    "DESKTOP_INPUT": "DESKTOP_INPUT", "CONTEXT": "CONTEXT", "EVIDENCE": "EVIDENCE",
}

# --- decomposition and decision evidence -----------------------------------------
JUDGMENT_TERMS = {
    "approve": ("approve", "approval", "承認"),
    "hold": ("hold", "保留"),
    "return_for_correction": ("return for correction", "reject back", "差戻し"),
    "exception": ("exception", "異常", "例外", "要確認", "要対応"),
    "manual_review": ("manual review", "review", "確認", "審査", "照合"),
    "ambiguous_interpretation": ("ambiguous", "判断", "判定", "interpretation"),
}
DECISION_TEXT = (r"(?i)(?:登録確定|承認|却下|保留|\bapprove(?:d|al)?\b|\bapproval\b|"
                 r"\breject(?:ed|ion)?\b|\bhold\b|\bconfirm\b|\bfinalize\b)")
POLICY_TEXT = r"(?i)(?:policy|規定|規則|判断|ambiguous|unclear|exception|例外|要確認|manual review)"
HUMAN_GATE_TEXT = (r"(?i)登録確定|保留|承認|却下|\bapprove\b|\bapproval\b|\bhold\b|\breject\b|"
                   r"\bconfirm\b|\bfinalize\b")
EXCEPTION_TEXT = r"(?i)\b(error|invalid|missing|exception|not found)\b|エラー|未入力|不備"

# --- semantic labels -----------------------------------------------------------
STATUS_RULES = (
    (r"未処理|unprocessed|pending processing|処理待ち", "UNPROCESSED_OR_PENDING"),
    (r"処理済|processed|完了|completed", "PROCESSED_OR_COMPLETED"),
    (r"保留|hold", "HOLD"),
    (r"承認|approval|approved|承認済", "APPROVAL"),
    (r"却下|reject|rejected", "REJECTED"),
)
ACTION_RULES = (
    (r"登録確定|confirm|finalize|register", "CONFIRM_OR_FINALIZE"),
    (r"保留|hold", "HOLD"),
    (r"承認|approve|approval", "APPROVE"),
    (r"却下|reject|rejection", "REJECT"),
    (r"変更|change|modify|update", "CHANGE_OR_UPDATE"),
    (r"申請|apply|application|request", "SUBMIT_OR_REQUEST"),
    (r"精算|reimbursement|settle", "REIMBURSEMENT_PROCESSING"),
)
REQUEST_RULES = (
    (r"給与変更|payroll change|payroll", "PAYROLL_CHANGE"),
    (r"経費精算|expense reimbursement|expense", "EXPENSE_REIMBURSEMENT"),
    (r"扶養控除変更|dependent.?tax|dependent deduction", "DEPENDENT_DEDUCTION_CHANGE"),
    (r"役職手当新設|allowance|role allowance", "ALLOWANCE_CHANGE"),
    (r"交通費|transportation expense", "TRANSPORTATION_EXPENSE"),
    (r"勤怠|attendance", "ATTENDANCE"),
    (r"休暇申請|leave application|leave", "LEAVE_APPLICATION"),
)
DOCUMENT_RULES = (
    (r"word|document|文書|書類", "WORD_OR_DOCUMENT"),
    (r"excel|spreadsheet|表計算", "EXCEL_OR_SPREADSHEET"),
    (r"notepad|メモ", "NOTEPAD_OR_MEMO"),
)
DECISION_RULES = (
    (r"登録確定|confirm|finalize", "CONFIRM_OR_FINALIZE"),
    (r"保留|hold", "HOLD"),
    (r"承認|approve|approval", "APPROVE"),
    (r"却下|reject|rejection", "REJECT"),
)
CASE_RULES = (
    (r"expense reimbursement|reimbursement|経費精算|経費", "EXPENSE_REIMBURSEMENT"),
    (r"payroll change|給与変更|payroll", "PAYROLL_CHANGE"),
    (r"dependent deduction|dependent.?tax|扶養控除", "DEPENDENT_DEDUCTION_CHANGE"),
    (r"transportation expense|交通費", "TRANSPORTATION_EXPENSE"),
    (r"allowance|手当", "ALLOWANCE_CHANGE"),
    (r"social insurance|社会保険", "SOCIAL_INSURANCE"),
    (r"attendance|勤怠", "ATTENDANCE"),
    (r"leave application|leave|休暇申請", "LEAVE_APPLICATION"),
    (r"tax|税", "TAX_RELATED"),
)
INSTRUCTION_RULES = (
    (r"入力|enter|input|記入|fill", "ENTER_OR_FILL"),
    (r"確認|check|review|verify", "REVIEW_OR_VERIFY"),
    (r"選択|select|choose", "SELECT"),
    (r"保存|save", "SAVE"),
    (r"提出|submit", "SUBMIT"),
    (r"登録|register", "REGISTER"),
)
FIELD_RULES = (
    (r"employee\s*id|社員\s*id|社員番号", "EMPLOYEE_ID"),
    (r"氏名|employee name|name|full name", "EMPLOYEE_NAME"),
    (r"区分|category", "CATEGORY"),
    (r"金額|amount", "AMOUNT"),
    (r"種別|type", "TYPE"),
    (r"ステータス|status", "STATUS"),
    (r"処理コメント|processing comments?", "PROCESSING_COMMENT"),
    (r"変更種別|change type", "CHANGE_TYPE"),
    (r"遡及|retroactive", "RETROACTIVE_FLAG"),
)
OBJECT_RULES = (
    (r"employee|社員|従業員|給与|payroll|経費|expense", "EMPLOYEE_RECORD"),
    (r"申請|application|request", "EMPLOYEE_APPLICATION_OR_REQUEST"),
)
FIELD_ALIASES = {
    "employee_id": ("employee_id", "employeeid", "employee id", "社員番号", "社員id"),
    "employee_name": ("employee_name", "employee name", "氏名", "社員名"),
    "category": ("category", "カテゴリ", "区分"),
    "amount": ("amount", "金額", "支給額", "費用"),
    "request_type": ("request_type", "request type", "申請種別", "依頼種別", "type", "種別", "変更種別"),
    "status": ("status", "ステータス", "状態"),
    "processing_comment": ("processing_comment", "processing comment", "処理コメント",
                           "確認コメント", "処理内容"),
    "effective_date": ("effective_date", "effective date", "適用日", "対象日"),
    "change_type": ("change_type", "change type", "変更種別"),
    "retroactive_flag": ("retroactive_flag", "retroactive flag", "遡及"),
}
SUPPORTED_CASES = ("expense_reimbursement", "payroll_change", "dependent_deduction_change",
                   "transportation_expense")
JAPANESE = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]"
