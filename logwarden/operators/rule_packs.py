"""Shipped detection rules.

Fixed values: rule ids, fields, patterns, scores and severities. Add detections by
passing other rules of the same shape; no code changes are needed.
"""

from __future__ import annotations


def _rule(category: str, rule_id: str, field: str, kind: str, pattern: str,
          score: int, severity: str, description: str) -> dict:
    return {"category": category, "id": rule_id, "field": field, "type": kind, "pattern": pattern,
            "score": score, "severity": severity, "description": description}


# Texts of which a match holds at least one, in lower case. They let the scan skip a
# slow pattern (look-aheads are tried at every position) for most requests.
NEEDED_TEXT = {
    "sqli_union_select": ["union"],
    "sqli_stacked_query": [";"],
    "sqli_comment_with_context": ["--", "#", "/*"],
    "xss_html_event_handler": ["<"],
    "xss_javascript_uri": ["javascript"],
    "traversal_dotdot": [".."],
    "traversal_encoded_dotdot_raw": ["%2", "%25"],
    "scanner_sqlmap_ua": ["sqlmap"],
    "scanner_nikto_ua": ["nikto"],
    "scanner_nmap_ua": ["nmap"],
    "sensitive_admin_path": ["admin", "manager", "console"],
    "sensitive_admin_success_or_forbidden": ["admin", "manager", "console"],
    "sqli_or_true": ["="],
    "sqli_time_based": ["sleep", "benchmark", "waitfor"],
    "sqli_comment": ["--", "#", "/*"],
    "xss_event_handler": ["="],
    "traversal_encoded_dotdot": ["%2"],
    "traversal_windows_files": [".ini"],
    "sensitive_env_file": [".env"],
}

DEFAULT_RULES = [
    _rule("sqli", "sqli_boolean_or", "query_string", "regex",
          r"(?:'|\b)(?:\s|/\*.*?\*/)*(?:or|and)(?:\s|/\*.*?\*/)+\d+\s*=\s*\d+",
          55, "high", "Always-true OR/AND comparison"),
    _rule("sqli", "sqli_union_select", "query_string", "regex",
          r"\bunion\s+(?:all\s+)?select\b",
          65, "high", "UNION SELECT"),
    _rule("sqli", "sqli_stacked_query", "query_string", "regex",
          r";\s*(?:drop|insert|update|delete|select|create|alter)\b",
          70, "critical", "Second statement after a semicolon"),
    _rule("sqli", "sqli_comment_with_context", "query_string", "regex",
          r"(?=.*(?:'|\bunion\b|\bselect\b|\bor\b|\band\b|;))(?:--|#|/\*)",
          20, "medium", "Comment marker next to other SQL signs"),
    _rule("xss", "xss_script_tag", "request", "contains", "<script",
          70, "high", "Script tag"),
    _rule("xss", "xss_html_event_handler", "request", "regex",
          r"<(?:svg|img|iframe|object|embed|form|input|details|body|meta|a)\b[^>]*(?:onload|onerror|ontoggle|onclick|onmouseover|srcdoc|javascript:)",
          70, "high", "Tag with an event handler"),
    _rule("xss", "xss_javascript_uri", "request", "regex", r"\bjavascript\s*:",
          60, "high", "javascript: address"),
    _rule("traversal", "traversal_dotdot", "url", "regex", r"(?:^|/)\.\.(?:/|$)",
          60, "high", "Parent-folder path step"),
    _rule("traversal", "traversal_encoded_dotdot_raw", "raw_uri", "regex",
          r"%(?:25)*2e%(?:25)*2e|%(?:25)*2e\.|\.%(?:25)*2e",
          45, "medium", "Encoded parent-folder step in the raw target"),
    _rule("scanner", "scanner_sqlmap_ua", "user_agent", "regex", r"\bsqlmap(?:/|\b|[-_])",
          30, "medium", "sqlmap client"),
    _rule("scanner", "scanner_nikto_ua", "user_agent", "regex", r"\bnikto\b",
          30, "medium", "Nikto client"),
    _rule("scanner", "scanner_nmap_ua", "user_agent", "regex", r"\bnmap\b|nmap scripting engine",
          25, "medium", "Nmap client"),
    _rule("sensitive_path", "sensitive_admin_path", "uri", "regex",
          r"(?:^|/)(?:admin|administrator|wp-admin|phpmyadmin|manager|console)(?:/|$)",
          20, "low", "Administration path"),
    _rule("sensitive_path", "sensitive_admin_success_or_forbidden", "request", "regex",
          r"(?=.*(?:^|/)(?:admin|administrator|wp-admin|phpmyadmin|manager|console)(?:/|$))(?=.*\b(?:status=)?(?:200|401|403)\b)",
          35, "medium", "Administration path with a telling status"),
    _rule("evasion", "evasion_multi_decode", "decode_depth", "regex", r"^[2-9][0-9]*$",
          20, "medium", "Several layers of encoding"),
    _rule("evasion", "evasion_control_chars_removed", "removed_control_chars", "contains", "true",
          20, "medium", "Control or format characters were removed"),
]

BROAD_RULES = [
    _rule("sqli", "sqli_or_true", "request", "regex", r"""('|%27|")\s*(or|and)\s+\d+\s*=\s*\d+""",
          35, "high", "Always-true comparison"),
    _rule("sqli", "sqli_union_select", "request", "regex", r"union\s+(all\s+)?select",
          40, "high", "UNION SELECT"),
    _rule("sqli", "sqli_information_schema", "request", "contains", "information_schema",
          35, "high", "Metadata tables"),
    _rule("sqli", "sqli_time_based", "request", "regex",
          r"(sleep\s*\(|benchmark\s*\(|waitfor\s+delay)",
          40, "high", "Time-based probe"),
    _rule("sqli", "sqli_comment", "request", "regex", r"(--|#|/\*)",
          15, "medium", "Comment marker"),
    _rule("xss", "xss_script_tag", "request", "contains", "<script",
          40, "high", "Script tag"),
    _rule("xss", "xss_event_handler", "request", "regex", r"on(error|load|click|mouseover|focus)\s*=",
          35, "high", "Event handler"),
    _rule("xss", "xss_javascript_uri", "request", "contains", "javascript:",
          30, "medium", "javascript: address"),
    _rule("xss", "xss_cookie_theft", "request", "contains", "document.cookie",
          35, "high", "Cookie access"),
    _rule("path_traversal", "traversal_dotdot", "request", "regex", r"(\.\./|\.\.\\)",
          35, "high", "Parent-folder path step"),
    _rule("path_traversal", "traversal_encoded_dotdot", "request", "regex", r"(%2e%2e|%252e%252e)",
          35, "high", "Encoded parent-folder step"),
    _rule("path_traversal", "traversal_linux_passwd", "request", "contains", "/etc/passwd",
          45, "high", "Linux password file"),
    _rule("path_traversal", "traversal_windows_files", "request", "regex",
          r"(boot\.ini|win\.ini|windows/win\.ini|windows\\win\.ini)",
          40, "high", "Windows system files"),
    _rule("scanner", "scanner_sqlmap", "user_agent", "contains", "sqlmap",
          45, "high", "sqlmap client"),
    _rule("scanner", "scanner_nikto", "user_agent", "contains", "nikto",
          40, "high", "Nikto client"),
    _rule("scanner", "scanner_acunetix", "user_agent", "contains", "acunetix",
          40, "high", "Acunetix client"),
    _rule("scanner", "scanner_gobuster", "user_agent", "contains", "gobuster",
          35, "medium", "Gobuster client"),
    _rule("scanner", "scanner_ffuf", "user_agent", "contains", "ffuf",
          35, "medium", "ffuf client"),
    _rule("scanner", "scanner_nmap", "user_agent", "contains", "nmap",
          30, "medium", "Nmap client"),
    _rule("sensitive_paths", "sensitive_env_file", "uri", "regex", r"(^|/)\.env$",
          35, "high", "Environment file"),
    _rule("sensitive_paths", "sensitive_admin_path", "uri", "regex", r"(/admin|/wp-admin|/phpmyadmin)",
          15, "low", "Administration path"),
]

for _r in DEFAULT_RULES + BROAD_RULES:
    if _r["id"] in NEEDED_TEXT:
        _r["needs"] = NEEDED_TEXT[_r["id"]]
