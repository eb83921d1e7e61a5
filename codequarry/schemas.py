"""Fixed values of the data model: enumerated domains and table schemas."""

# Enumerated domains (fixed values).
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
FINDING_STATUSES = ["OPEN", "RESOLVED", "FALSE_POSITIVE", "SUPPRESSED"]
SCAN_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]
VERDICTS = ["CONFIRMED", "POSSIBLE", "REJECTED"]
PATCH_STATUSES = ["DRAFT", "VERIFIED", "NEEDS_REVIEW", "REJECTED", "APPROVED"]
SYMBOL_KINDS = ["FUNCTION", "CLASS", "METHOD", "IMPORT", "FASTAPI_ROUTE", "EXPRESS_ROUTE", "FETCH_CALL", "AXIOS_CALL"]
NODE_KINDS = ["FILE", "SYMBOL", "ROUTE", "FRONTEND_REQUEST", "TEST", "DEPENDENCY"]
EDGE_KINDS = ["CONTAINS", "CALLS", "IMPORTS", "EXPOSES_ROUTE", "REQUESTS_ROUTE", "MATCHES_ROUTE", "TESTS", "DEPENDS_ON"]
CONTRACT_STATUSES = ["MATCHED", "METHOD_MISMATCH", "PATH_MISMATCH", "UNMATCHED_FRONTEND_REQUEST", "AMBIGUOUS_MATCH"]
TOOL_STATUSES = ["COMPLETED", "FAILED", "TIMEOUT", "UNAVAILABLE", "DISABLED", "INVALID_OUTPUT", "SKIPPED"]
CHECK_STATUSES = ["PASSED", "FAILED", "SKIPPED", "NEEDS_REVIEW", "UNAVAILABLE", "NOT_APPLICABLE"]
TERMINAL_SCAN = ["COMPLETED", "FAILED"]

# Symbol kinds that become chunks, and the kind of the chunk (fixed values).
CHUNK_KINDS = {"FUNCTION": "FUNCTION", "CLASS": "CLASS", "METHOD": "METHOD", "FASTAPI_ROUTE": "ROUTE", "EXPRESS_ROUTE": "ROUTE"}

DETAILS = (
    "struct<http_method: string, path: string, handler: string, url: string, target: string, is_from: boolean, module: string, source: string, "
    "imported_names: map<string,string>, modules: map<string,string>, namespace_import: string, default_import: string, snippet: string>"
)
FILES = "file_seq int, path string, language string, size_bytes bigint, lines_count int, is_binary boolean, skipped_reason string, content string"
SYMBOLS = f"file_seq int, sym_seq int, path string, name string, kind string, start_line int, end_line int, start_column int, end_column int, details {DETAILS}"
CALLS = "file_seq int, call_seq int, path string, callee string, callee_name string, callee_base string, line_number int, column_number int, caller_name string, caller_kind string, caller_start_line int"
EVIDENCE = "struct<file_path: string, start_line: int, end_line: int, code_snippet: string, context_notes: string>"
STATIC_FINDINGS = f"tool string, rule_id string, title string, description string, severity string, category string, evidence {EVIDENCE}, mitigation string, confidence string, source_tool string, detector_id string, detector_kind string"
NODES = "write_seq bigint, id string, kind string, label string, file_path string, start_line int, end_line int, metadata string"
EDGES = "write_seq bigint, source string, target string, kind string, metadata string"
DIFF_LINES = "patch_id string, file_idx int, path string, hunk_idx int, orig_start int, orig_count int, new_start int, new_count int, line_idx int, prefix string, content string"
