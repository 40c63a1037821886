"""The relational schema: change sets, files, lines, surfaces, findings, scores.

`cs_id` keys everything: one plan handles any number of change sets. `*_ord` columns keep the order
that nested arrays have. DDL strings are what mapInArrow, UDTFs and readers take.
"""

from __future__ import annotations

LINE = "struct<line:int,text:string>"
HUNK = f"struct<base_start:int,base_lines:int,head_start:int,head_lines:int,added:array<{LINE}>,removed:array<{LINE}>>"
HUNKS = f"array<{HUNK}>"

FILE_CHANGES = f"cs_id long, file_ord int, path string, kind string, base_path string, base_content string, head_content string, is_binary boolean, hunks {HUNKS}"
CHANGESETS = "cs_id long, base_ref string, head_ref string, commit_messages array<string>, parse_error string"

ASSERTION = "struct<kind:string,callee:string,line:int,operands:array<string>,tolerance:double,negated:boolean,literal:array<boolean>,swallowed:boolean>"
SKIP = "struct<reason:string,line:int,expression:string>"
MOCK = "struct<target:string,line:int,callee:string>"
RETRY = "struct<callee:string,line:int,max_attempts:int>"
TEST = (
    "struct<id:string,name:string,qualname:string,line_start:int,line_end:int,is_discoverable:boolean,"
    f"assertions:array<{ASSERTION}>,skip_markers:array<{SKIP}>,mocks:array<{MOCK}>,retries:array<{RETRY}>,exercised_symbols:array<string>>"
)
SURFACE = f"status string, language string, framework string, parse_ok boolean, parse_error string, tests array<{TEST}>"

EVIDENCE = "struct<path:string,line:int,side:string,snippet:string>"
FINDINGS = f"cs_id long, rule_id string, severity string, title string, detail string, path string, penalty int, evidence array<{EVIDENCE}>, justification string, file_ord int, check_ord int, line_ord int"

# Kinds of change, sides, severities by rank, assertion strengths, skip reasons, surface states.
KINDS = ("added", "modified", "deleted", "renamed")
SEVERITIES = ("info", "low", "medium", "high", "critical")
STRENGTH = {
    "equality": 100, "identity": 100, "snapshot": 90, "approximate": 80, "exception": 75, "comparison": 70, "membership": 70,
    "type": 50, "call": 45, "custom": 40, "unknown": 40, "truthiness": 30, "existence": 20,
}
SKIP_REASONS = ("skip", "skip_if", "expected_failure", "todo", "exclusive_focus")
#: not_applicable: no surface; absent: that side has no file; unknown: content wasn't loaded; unparsed: a syntax error.
STATES = ("not_applicable", "absent", "unknown", "unparsed", "parsed")
