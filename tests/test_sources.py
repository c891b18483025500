import json
import subprocess

import pytest
from corpus import TEXTS
from pyspark.sql import functions as F

from tarn.__main__ import main
from tarn.sources.bundle import read_queries
from tarn.sources.directory import git_changes, name_status, read_bucket, read_directory
from tarn.sources.frontmatter import parse, split
from tarn.sources.ignore import visible_files


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def test_front_matter():
    source = "---\ntitle: T\nsummary: S\ncanonical_url: https://e.org\nlang: en\nweight: 2\npublished: true\nwhen: 2024-01-02\n---\n# H\nbody\n"
    got = parse(source, "a/b.md")
    assert (got["title"], got["summary"], got["canonical_url"], got["content"]) == ("T", "S", "https://e.org", "# H\nbody\n")
    assert json.loads(got["metadata_json"]) == {"lang": "en", "weight": 2, "published": True, "when": "2024-01-02"}


def test_front_matter_with_crlf_and_camel_case():
    got = parse("---\r\ncanonicalUrl: u\r\n---\r\nbody", "x.md")
    assert (got["canonical_url"], got["content"], got["title"]) == ("u", "body", "x")


def test_nested_values_and_lifted_fields_that_are_no_text():
    got = parse("---\ntitle: [1]\ntags: [a, b]\nconfig: {x: {y: null}, 1: z}\n---\n# From heading\n", "x.md")
    assert got["title"] == "From heading"
    assert json.loads(got["metadata_json"]) == {"tags": ["a", "b"], "config": {"x": {"y": None}, "1": "z"}}


@pytest.mark.parametrize("source", ["---\n: : bad\n  - x\n---\nbody", "---\n- a\n---\nbody", "---\na: &x 1\nb: *x\n---\nbody", "---\n---\nbody", "---\na: 1\n---", "body"])
def test_what_is_no_front_matter_is_content(source):
    got = parse(source, "dir/name.txt")
    assert got["content"] == source and got["metadata_json"] == "{}" and got["title"] == "name"


def test_split_needs_a_line():
    assert split("---\na: 1\n---\nrest") == ("a: 1", "rest") and split("---\n---\n") is None


def test_visible_files(tmp_path):
    root = tmp_path / ".hidden-root"
    write(
        root,
        {n: "x" for n in ("a.md", "b.MD", "c.txt", "d.mdx", "e.rst", ".f.md", ".g/h.md", "node_modules/i.md", "sub/dist/j.md", "sub/k.md", "sub/l.md", "sub/deep/m.md", "logs/n.md", "keep/o.md", "x/target.md")}
        | {".gitignore": "/c.txt\nlogs/\n*.mdx\nkeep/*\n!keep/o.md\n", "sub/.gitignore": "l.md\ndeep/**\n"},
    )
    assert visible_files(root) == ["a.md", "keep/o.md", "sub/k.md", "x/target.md"]


def test_read_directory(spark, tmp_path):
    write(tmp_path, dict(TEXTS) | {"odd name+[é].md": "text", "skip.py": "x"})
    rows = {r.relative_path: r for r in read_directory(spark, tmp_path).collect()}
    assert set(rows) == {*TEXTS, "odd name+[é].md"}
    assert rows["guides/rust.md"].title == "Rust Guide" and rows["guides/rust.md"].content == TEXTS["guides/rust.md"]
    assert {r.relative_path for r in read_bucket(spark, str(tmp_path)).where(~F.col("relative_path").contains("odd")).collect()} == set(TEXTS)
    (tmp_path / "empty").mkdir()
    assert read_directory(spark, tmp_path / "empty").count() == 0


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@e.org", "-C", str(root), *args], check=True, capture_output=True)


def test_git_changes(tmp_path):
    root = tmp_path / "docs"
    write(root, {"a.md": "1", "b.md": "2", "c.md": "long text to rename " * 9, "n.py": "x"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    write(root, {"a.md": "changed", "new.md": "3", "n.py": "y"})
    (root / "b.md").unlink()
    git(tmp_path, "mv", "docs/c.md", "docs/d.md")
    assert git_changes(root) == (["a.md", "d.md", "new.md"], ["b.md", "c.md"])
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "two")
    assert git_changes(root) == ([], [])
    assert git_changes(root, "HEAD~1") == (["a.md", "d.md", "new.md"], ["b.md", "c.md"])
    with pytest.raises(RuntimeError):
        git_changes(root, "no-such-revision")


def test_name_status():
    assert name_status(b"M\0a\0D\0b\0R100\0c\0d\0C75\0e\0f\0A\0g\0") == ({"a", "d", "f", "g"}, {"b", "c"})


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "in", TEXTS)
    index, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    said = lambda *a: (main(list(a)), json.loads(capsys.readouterr().out))[1]
    assert said("build", str(tmp_path / "in"), index)["chunk_count"] == 6
    assert said("search", index, "rust toolchain setup", "--top-k", "1", "--path-prefix", "guides/")[0]["relative_path"] == "guides/rust.md"
    assert said("update-cache", str(tmp_path / "in"), cache)["new"] == 3
    assert said("export-index", cache, str(tmp_path / "again"))["document_count"] == 3
    assert said("inspect", str(tmp_path / "again"))["chunk_count"] == 6 and said("inspect", cache)["active_documents"] == 3
    assert said("export-bundle", index, str(tmp_path / "bundle"))["chunkCount"] == 6
    queries = {"name": "basic", "queries": [{"name": "net", "query": "packet traces", "expected_top_hit": "ops/network.md"}]}
    (tmp_path / "q.json").write_text(json.dumps(queries))
    assert read_queries(spark, str(tmp_path / "q.json")).first().top_k == 5
    assert said("benchmark", index, str(tmp_path / "q.json"))["passed"] == 1
    assert main(["search", index, "latency", "--text"]) == 0 and "ops/network.md" in capsys.readouterr().out
    assert main(["search", index, "x", "--mode", "odd"]) == 1
