from __future__ import annotations

import json
import subprocess

import pytest

from tessera.sources.git import Blobs, GitError, files_of, load, load_range, messages, read_ranges
from tessera.sources.pairs import hunks


@pytest.fixture
def repository(tmp_path):
    def git(*a):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.invalid", *a], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "keep.py").write_text("one\ntwo\n")
    (tmp_path / "gone.py").write_text("bye\n")
    (tmp_path / "pic.bin").write_bytes(bytes(range(256)))
    git("add", "-A")
    git("commit", "-qm", "first")
    (tmp_path / "keep.py").write_text("one\nTWO\n")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "new.py").write_bytes(b"hi\r\n")
    (tmp_path / "pic.bin").write_bytes(bytes(range(255, -1, -1)))
    git("add", "-A")
    git("commit", "-qm", "second\n\nGate-Justification: VID009 - agreed")
    return tmp_path


def test_range(repository):
    files, said = load(repository, "HEAD~1", "HEAD")
    by = {f["path"]: f for f in files}
    assert {p: f["kind"] for p, f in by.items()} == {"keep.py": "modified", "gone.py": "deleted", "new.py": "added", "pic.bin": "modified"}
    assert (by["keep.py"]["base_content"], by["keep.py"]["head_content"]) == ("one\ntwo\n", "one\nTWO\n")
    assert by["gone.py"]["head_content"] is None and by["new.py"]["base_content"] is None and by["new.py"]["head_content"] == "hi\n"
    assert by["pic.bin"]["is_binary"] and by["pic.bin"]["base_content"] is None
    assert said == ["second\n\nGate-Justification: VID009 - agreed"]


def test_failures(repository, tmp_path):
    with pytest.raises(GitError):
        load(repository, "nosuch", "HEAD")
    with pytest.raises(GitError):
        load(tmp_path / "missing", "a", "b")


def test_dataframes(spark, repository):
    sets, files = load_range(spark, repository, "HEAD~1", "HEAD", cs_id=5)
    assert files.count() == 4 and sets.first()["commit_messages"][0].startswith("second")
    ranges = spark.createDataFrame([(1, str(repository), "HEAD~1", "HEAD"), (2, str(repository), "bad", "HEAD")], "cs_id long, repository string, base string, head string")
    loaded = read_ranges(ranges)
    assert {r["cs_id"]: r["parse_error"] is None for r in loaded.collect()} == {1: True, 2: False}
    assert files_of(loaded).count() == 4


def test_messages_and_hunks():
    assert messages(" a\n\0\n\0b\0") == ["a", "b"]
    (h,) = hunks("a\nb\nc\n", "a\nB\nc\n")
    assert h["removed"] == [{"line": 2, "text": "b"}] and h["added"] == [{"line": 2, "text": "B"}]
    assert hunks(None, "x\n")[0]["added"] == [{"line": 1, "text": "x"}] and hunks("x", "x\n") == []


def test_data_source(spark, repository, tmp_path_factory):
    from tessera.plans.gate import gate
    from tessera.sources.git import register, split_ranges

    register(spark)
    ranges = [{"cs_id": 1, "repository": str(repository), "base": "HEAD~1", "head": "HEAD"}, {"cs_id": 2, "repository": str(repository), "base": "nowhere", "head": "HEAD"}, {"cs_id": 3, "repository": str(repository), "base": "HEAD", "head": "HEAD"}, {"cs_id": 4, "repository": str(tmp_path_factory.mktemp("none") / "x"), "base": "a", "head": "b"}]
    rows = spark.read.format("git_ranges").option("ranges", json.dumps(ranges)).load()
    assert rows.rdd.getNumPartitions() == 4
    sets, files = split_ranges(rows)
    told = {r["cs_id"]: r for r in sets.collect()}
    assert sorted(told) == [1, 2, 3, 4] and told[1]["parse_error"] is None and told[1]["commit_messages"] == ["second\n\nGate-Justification: VID009 - agreed"] and told[3]["parse_error"] is None
    assert "failed" in told[2]["parse_error"] and "can't be run" in told[4]["parse_error"]
    one, changed = load_range(spark, repository, "HEAD~1", "HEAD", cs_id=1)
    assert sorted(map(str, files.collect())) == sorted(map(str, changed.select(*files.columns).collect()))
    done = gate(sets, files, keep=False)
    assert {r["cs_id"]: r["value"] for r in done.scores.collect()} == {1: 100, 3: 100}
    bare = spark.read.format("git_ranges").option("repository", str(repository)).option("base", "HEAD~1").option("head", "HEAD").option("contents", "false").load()
    assert bare.count() == 4 and bare.where("base_content is not null or head_content is not null").count() == 0
    with pytest.raises(Exception, match="failed:|can't be run"):
        spark.read.format("git_ranges").option("ranges", json.dumps(ranges)).option("mode", "failfast").load().collect()
    for options in ({"repository": "x"}, {"ranges": json.dumps(ranges), "mode": "other"}):
        with pytest.raises(Exception, match="range has|no such mode"):
            spark.read.format("git_ranges").options(**options).load().collect()


def test_blobs(repository):
    with Blobs(repository) as blobs:
        asked = [("HEAD~1", "keep.py"), ("HEAD", "nothing"), ("HEAD", "new.py"), ("nowhere", "keep.py"), ("HEAD", "a\nb"), ("HEAD", ""), ("HEAD", "keep.py")]
        assert [blobs.read(*x) for x in asked] == ["one\ntwo\n", None, "hi\n", None, None, None, "one\nTWO\n"]
