from __future__ import annotations

import pytest

from tessera.sources.unified_diff import DiffError, parse, read_diffs, unquoted


def diff(path: str, *body: str, head: str | None = None) -> str:
    return "\n".join([head or f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", *body]) + "\n"


TWO_HUNKS = diff("lib/calc.py", "@@ -3,4 +3,5 @@ def add():", " keep", "-gone", "+fresh", "+more", " keep", " tail", "@@ -40 +41,0 @@", "-last")


def test_nothing_to_read():
    assert parse("") == [] and parse("\n  \n\n") == []


def test_lines_are_numbered_on_both_sides():
    (f,) = parse(TWO_HUNKS)
    assert (f["path"], f["kind"], f["is_binary"]) == ("lib/calc.py", "modified", False)
    first, second = f["hunks"]
    assert first["removed"] == [{"line": 4, "text": "gone"}]
    assert first["added"] == [{"line": 4, "text": "fresh"}, {"line": 5, "text": "more"}]
    assert (second["base_lines"], second["head_lines"], second["removed"]) == (1, 0, [{"line": 40, "text": "last"}])


def test_added_deleted_and_order():
    text = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+x\n" + "diff --git a/o.py b/o.py\ndeleted file mode 100644\n--- a/o.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n"
    assert [(f["path"], f["kind"]) for f in parse(text)] == [("n.py", "added"), ("o.py", "deleted")]


def test_rename_with_spaces_and_edit():
    text = "diff --git a/old name.py b/new name.py\nsimilarity index 90%\nrename from old name.py\nrename to new name.py\n--- a/old name.py\t\n+++ b/new name.py\t\n@@ -1 +1 @@\n-a\n+b\n"
    (f,) = parse(text)
    assert (f["kind"], f["base_path"], f["path"]) == ("renamed", "old name.py", "new name.py")


@pytest.mark.parametrize("body", ["Binary files a/p.png and b/p.png differ\n", "GIT binary patch\nliteral 3\nKcmZ\n\n"])
def test_binary(body):
    (f,) = parse("diff --git a/p.png b/p.png\nindex 1..2 100644\n" + body)
    assert f["is_binary"] and f["hunks"] == [] and f["path"] == "p.png" and f["kind"] == "modified"


def test_new_and_removed_binaries():
    assert parse("diff --git a/p.png b/p.png\nnew file mode 100644\nBinary files /dev/null and b/p.png differ\n")[0]["kind"] == "added"
    assert parse("diff --git a/p.png b/p.png\ndeleted file mode 100644\nBinary files a/p.png and /dev/null differ\n")[0]["kind"] == "deleted"


def test_marker_of_a_missing_line_end_is_no_line():
    (f,) = parse(diff("x.py", "@@ -1,2 +1,2 @@", " a", "-b", "\\ No newline at end of file", "+c", "\\ No newline at end of file"))
    assert f["hunks"][0]["added"] == [{"line": 2, "text": "c"}]


def test_quoted_paths():
    assert unquoted('"a/caf\\303\\251 \\"q\\".py"') == 'a/café "q".py'
    (f,) = parse('diff --git "a/caf\\303\\251.py" "b/caf\\303\\251.py"\nold mode 100644\nnew mode 100755\n')
    assert (f["path"], f["kind"], f["hunks"]) == ("café.py", "modified", [])


def test_blank_context_line_and_unknown_headers():
    (f,) = parse(diff("x.py", "@@ -1,3 +1,3 @@", "", "-b", "+c", " d", head="diff --git a/x.py b/x.py\ncopy from z.py"))
    assert f["hunks"][0]["added"] == [{"line": 2, "text": "c"}]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("hello\n", "expected a 'diff --git' header"),
        (diff("x.py", "@@ -1,3 +1,3 @@", " a"), "ended before"),
        (diff("x.py", "@@ one @@", " a"), "malformed hunk header"),
        (diff("x.py", "@@ -1 +1 @@", "-a", "+b", "+stray"), "outside of any hunk"),
        (diff("x.py", "@@ -1,2 +1,2 @@", "?a"), "malformed hunk line"),
        ("diff --git a/x b/y\nrename from x\n", "missing 'from' or 'to'"),
        ("diff --git a/x b/x\nBinary files differ\n", "malformed binary-file header"),
        ("diff --git nothing\nnew file mode 100644\n", "no path"),
    ],
)
def test_malformed(text, said):
    with pytest.raises(DiffError, match=said.replace("(", r"\(")):
        parse(text)


def test_one_bad_diff_is_one_row(spark):
    diffs = spark.createDataFrame([(1, TWO_HUNKS), (2, "junk"), (3, None)], "cs_id long, raw string")
    rows = {r["cs_id"]: r for r in read_diffs(diffs).collect()}
    assert set(rows) == {1, 2} and rows[1]["path"] == "lib/calc.py" and rows[2]["parse_error"].startswith("expected") and rows[2]["path"] is None
    with pytest.raises(Exception, match="expected a 'diff --git' header"):
        read_diffs(diffs, mode="FAILFAST").collect()
    with pytest.raises(ValueError, match="no such mode"):
        read_diffs(diffs, mode="OTHER")
