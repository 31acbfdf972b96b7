import datetime as dt
import io
import json
import os
import subprocess
import tarfile
import zipfile

import pytest

from marrow import cli, importing
from marrow.operators import codegraph
from marrow.service import Service
from marrow.sources import archives, git, markdown, state

DOC = "---\ntype: api\ntitle: Users API\ntags:\n  - go\nlevel: 3\nlanguage: 1\nok: yes\n---\n## Body\nDetails\n"


def test_parse():
    d = markdown.parse_document(DOC, "x.md")
    assert (d["type"], d["title"], d["tags"], d["content"]) == ("api", "Users API", ["go"], "## Body\nDetails\n")
    assert d["custom"] == {"level": "3", "ok": "yes"} and d["custom_types"]["language"] == "number"
    assert markdown.parse_document("plain body\n", "hello-world.md")["title"] == "hello world"
    assert markdown.parse_document("---\r\ntype: component\r\ntitle: 123\r\n---\r\n\r\nBody\r\n", "x.md")["content"] == "Body\r\n"
    assert markdown.parse_document("---\r\ntype: c\r\ntitle: 123\r\n---\r\nB", "x.md")["title"] == "123"
    assert markdown.parse_document("---\ntype: a\ntitle: b\n---", "n.md")["type"] == "concept"
    for bad in ("", "---\ntype: a\n---\nx", "---\ntitle: a\n---\nx", "---\ntype: [\ntitle: a\n---\nx", "---\ntype: a\ntype: b\ntitle: c\n---\nx"):
        with pytest.raises(markdown.DocumentError):
            markdown.parse_document(bad, "x.md")
    again = markdown.parse_document(markdown.render_document(d), "x.md")
    assert {k: again[k] for k in ("type", "title", "tags", "content", "custom")} == {k: d[k] for k in ("type", "title", "tags", "content", "custom")}
    assert markdown.validate_lenient("no front") == "" and markdown.validate_lenient("---\na: b\n") == "unterminated frontmatter" and markdown.validate_strict("no front") != ""


@pytest.mark.parametrize("title", ["中文", "😀", "שלום", "a\u200bb", "x" * 10_000, "- a: b", "'q\"", "true", "1.0", "# h", "null"])
def test_titles_survive(title):
    c = {"type": "t", "title": title, "tags": [title], "content": "b\n", "custom": {}, "description": title}
    d = markdown.parse_document(markdown.render_document(c), "x.md")
    assert (d["title"], d["tags"], d["description"]) == (title, [title], title)


def test_load_and_save(spark, tmp_path):
    for name, text in {"a-b/x.md": DOC, "a/x.md": DOC, "a/.hidden/y.md": DOC, "bad.md": "---\ntype: a\n---\n", "n.MD": DOC, "_u.md": "plain"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    concepts, rejects = markdown.load_bundle(spark, str(tmp_path))
    assert [r["file_path"] for r in concepts.orderBy("ord").collect()] == ["_u.md", "a/x.md", "a-b/x.md"]
    assert [r["file_path"] for r in rejects.collect()] == ["bad.md"]
    flat, _ = markdown.load_bundle(spark, str(tmp_path), recursive=False)
    assert flat.count() == 1
    from pyspark.sql import functions as F

    assert markdown.load_bundle(spark, str(tmp_path), where=F.col("path").startswith("a/"))[0].count() == 1
    same = concepts.withColumn("file_path", F.lit("")).where("ord > 0")
    out = tmp_path / "out"
    saved = {r["save_path"]: r["error"] for r in markdown.save_bundle(same, str(out)).collect()}
    assert len(saved) == 2 and set(saved.values()) == {None} and {"apis/Users API.md", "apis/Users API_1.md"} == set(saved)
    assert markdown.load_bundle(spark, str(out))[0].count() == 2


def test_archives(spark, tmp_path):
    def tar(path, names, mode="w:gz", link=False):
        with tarfile.open(path, mode) as t:
            for n in names:
                i = tarfile.TarInfo(n)
                i.size = 3
                t.addfile(i, io.BytesIO(b"abc"))
            if link:
                i = tarfile.TarInfo("l.md")
                i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(i)

    tar(tmp_path / "ok.tar.gz", ["d/a.md", "b.txt"])
    tar(tmp_path / "x.tar.xz", ["a.md"], "w:xz")
    tar(tmp_path / "up.tar", ["../a.md"], "w")
    tar(tmp_path / "abs.tar", ["/a.md"], "w")
    tar(tmp_path / "link.tar", ["a.md"], "w", link=True)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("q.md", "zip")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert [n for n, _ in archives.entries(str(tmp_path / "ok.tar.gz"))] == ["d/a.md"] and archives.entries(str(tmp_path / "x.tar.xz")) and archives.entries(str(tmp_path / "z.zip")) == [("q.md", b"zip")]
    for bad in ("up.tar", "abs.tar", "link.tar", "bad.zip"):
        with pytest.raises(archives.ArchiveError):
            archives.entries(str(tmp_path / bad))
    rows = archives.load_archives(spark, [str(tmp_path / "ok.tar.gz"), str(tmp_path / "up.tar")]).collect()
    assert sorted((r["file_path"] or "", bool(r["error"])) for r in rows) == [("", True), ("d/a.md", False)]


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "my repo"
    r.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(r), "-c", "user.name=Ann Lee", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (r / "main.go").write_text("package main\n\nfunc Start() {\n}\n")
    (r / "old name.py").write_text("def f():\n    return 1\n" * 5)
    run("add", "-A")
    run("commit", "-qm", "first")
    run("mv", "old name.py", "new.py")
    (r / "main.go").write_text("package main\n\nfunc Start() {\n\treturn\n}\n")
    run("commit", "-qam", "second")
    return r


def test_git(spark, repo):
    assert git.tracked_files(str(repo)) == ["main.go", "new.py"]
    rows = git.commits(str(repo), 5)
    assert [x[5] for x in rows] == ["second", "first"] and rows[0][8] == ["main.go", "new.py"] and rows[0][9] == ["old name.py"]
    assert git.changed_files(str(repo), "HEAD~1", "HEAD") == ["main.go", "new.py", "old name.py"]
    assert git.name_status("C100\0a\0b\0A\0c\0") == [("M", "b"), ("A", "c")]
    meta = {r["path"]: r for r in codegraph.commit_metadata(git.change_log(spark, str(repo))).collect()}
    assert meta["main.go"]["commit_count"] == 2 and meta["main.go"]["last_author"] == "Ann Lee"


def test_service_end_to_end(spark, repo, capsys):
    s = Service(spark, str(repo), str(repo / "kb" / "knowledge"))
    assert s.status()["result"]["initialized"] is False and s.query("x")["error"]["code"] == "knowledge_not_initialized"
    assert s.generate()["result"] == {"mode": "full", "concepts": 2, "removed": 0}
    assert s.freshness()["stale"] is False and s.generate(full=False)["result"]["mode"] == "unchanged"
    got = s.query("main.go", 5, explain=True)
    assert got["ok"] and got["result"]["hits"][0]["source_path"] == "main.go" and len(got["result"]["trace"]) == 6
    assert s.query("start", language="python")["result"]["hits"] == [] and s.query("main", language="go")["result"]["count"] == 1
    assert s.query("")["error"]["code"] == "invalid_query" and s.query("x", -1)["ok"] is False
    pack = s.context("Start", 50)
    assert pack["result"]["items"][0]["snippet"] == "func Start() {" and pack["result"]["used_tokens"] == 4
    assert cli.main(["query", "-q", "main.go", "--repo", str(repo), "--dir", str(repo / "kb" / "knowledge")], spark) == 0
    assert json.loads(capsys.readouterr().out)["operation"] == "query"
    assert cli.main(["search", "-q", "start", "--dir", str(repo / "kb" / "knowledge")], spark) == 0 and "main.go" in capsys.readouterr().out
    assert cli.main(["show", "--dir", str(repo / "kb" / "knowledge")], spark) == 0
    assert cli.main(["lint", "--dir", str(repo / "kb" / "knowledge")], spark) in (0, 1)


def test_import_and_sync(spark, tmp_path):
    src, kb = tmp_path / "src", tmp_path / "kb"
    (src / "d").mkdir(parents=True)
    kb.mkdir()
    (src / "d" / "a.md").write_text("---\ntitle: A\n---\nbody\n")
    (src / "b.MD").write_text("no frontmatter")
    (src / "bad.md").write_text("---\ntitle: [\n---\nx")
    index = state.load_index(spark, str(kb / "i.json"))
    plan = importing.plan_import(importing.list_sources(spark, [str(src)]), index, str(kb))
    counts, index = importing.apply_import(plan, index, str(kb))
    assert counts == {"total": 3, "imported": 2, "skipped": 0, "failed": 1}
    assert (kb / "d" / "a.md").read_text() == "---\ntitle: A\n---\nbody\n"
    state.save_index(index, str(kb / "i.json"))
    index = state.load_index(spark, str(kb / "i.json"))
    assert index.count() == 2
    counts, index = importing.sync(spark, index, str(kb))
    assert counts["imported"] == 0 and counts["skipped"] == 2
    (src / "d" / "a.md").write_text("---\ntitle: B\nextra: 1\n---\nother\n")
    os.utime(src / "d" / "a.md", (1, 1))
    (src / "b.MD").unlink()
    counts, index = importing.sync(spark, index, str(kb), "merge", prune=True)
    assert counts["imported"] == 1 and (kb / "d" / "a.md").read_text() == "---\nextra: 1\ntitle: A\n---\nbody\n"
    assert index.count() == 1
    # another source may not take a tracked target
    other = tmp_path / "other" / "d"
    other.mkdir(parents=True)
    (other / "a.md").write_text("mine")
    plan = importing.plan_import(importing.list_sources(spark, [str(tmp_path / "other")]), index, str(kb))
    assert "tracked already" in plan.where("result = 'new_file'").first()["error"]
    assert importing.rebuild_index(spark, str(kb)).count() == 1
    (kb / "d" / "a.md").unlink()
    assert importing.clean_index(index, str(kb)).count() == 0


def test_settings(tmp_path, monkeypatch):
    p = str(tmp_path / "c.yaml")
    assert state.load_settings(p) == state.Settings()
    state.save_settings(state.Settings("kb", ["o1", "o2", "o1", "."]), p)
    s = state.load_settings(p)
    got = state.resolve_paths(s, repo="/r")
    assert [(x.path, x.source, x.rank) for x in got] == [("kb", "config", 0), ("o1", "overlay", 1), ("o2", "overlay", 2)]
    assert state.resolve_paths(s, cli="c", env="e")[0].source == "cli" and state.resolve_paths(state.Settings(), repo="/r")[0].source == "repo_local"
    with pytest.raises(ValueError):
        state.watch_config({"version": 2, "rules": [{"sources": ["a"]}]}, "/b")
    with pytest.raises(ValueError):
        state.watch_config({"rules": []}, "/b")
    c = state.watch_config({"debounce": "1.5s", "rules": [{"sources": ["a", "/c"]}]}, "/b")
    assert c.rules[0].sources == ("/b/a", "/c") and c.rules[0].debounce_ms == 1500 and c.rules[0].strategy == "merge" and c.rules[0].patterns == ("**/*.md",)
    assert state.duration_ms("1m30s") == 90_000 and dt.timedelta(milliseconds=state.duration_ms("2h")) == dt.timedelta(hours=2)
    state.write_state(str(tmp_path / "kb" / "knowledge"), "abc")
    assert state.read_state(str(tmp_path / "kb" / "knowledge"))["last_indexed_commit"] == "abc"
