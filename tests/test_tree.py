"""Trees of files as a data source, and pages as a sink."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corroba.sources import tree
from corroba.sources.tree import changes_of, files_below


@pytest.fixture
def root(tmp_path):
    for path, text in {"README.md": "# R", "__init__.py": "", "src/a.py": "a = 1", "src/deep/er/b.PY": "b", "src/.hidden": "h", "docs/x.md": "é", "build/out.md": "no", "build/keep/y.md": "no", "we ird/%41.txt": "w"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (tmp_path / "empty").mkdir()
    return tmp_path


@pytest.mark.parametrize("spread", [1, 3, 64])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_of_a_tree(spark, root, spread, scheme):
    found = files_below(spark, f"{scheme}{root}", ("build/",), spread=spread).collect()
    assert {r.path: bytes(r.content).decode() for r in found} == {"README.md": "# R", "__init__.py": "", "src/a.py": "a = 1", "src/deep/er/b.PY": "b", "src/.hidden": "h", "docs/x.md": "é", "we ird/%41.txt": "w"}
    assert len(found) == 7  # each once, however the tree is cut
    row = next(r for r in found if r.name == "b.PY")
    assert (row.parent, row.depth, row.extension, row.size_bytes) == ("src/deep/er", 3, ".py", 1)


def test_ignored_directories_are_not_entered(root):
    class Watched(tree._Tree):
        opened = []

        def entries(self, prefix):
            self.opened.append(prefix)
            return super().entries(prefix)

    reader = tree.TreeReader({"path": str(root), "patterns": '["build/"]'})
    whole, tree._Tree = tree._Tree, Watched
    try:
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    finally:
        tree._Tree = whole
    assert "build" not in Watched.opened and "src/deep" in Watched.opened and len(rows) == 7


def test_taken_back_patterns(spark, root):
    assert {r.path for r in files_below(spark, str(root), ("*.md", "!docs/x.md", "src/"), contents=False).collect()} == {"__init__.py", "docs/x.md", "we ird/%41.txt"}


def test_paths_are_chosen_while_listing(spark, root):
    paths = lambda **asked: {r.path for r in files_below(spark, str(root), **asked).collect()}
    assert paths(prefixes=("src/a.py", "docs/")) == {"src/a.py", "docs/x.md"}
    assert paths(extensions=(".py", ".txt")) == {"__init__.py", "src/a.py", "src/deep/er/b.PY", "we ird/%41.txt"}
    assert paths(names="(^|/)[a-y].md$", prefixes=("build/",)) == {"build/keep/y.md"}
    assert paths(prefixes=("none",)) == set()
    reader = tree.TreeReader({"path": str(root), "prefixes": '["src/de"]'})
    assert reader.enters("src") and reader.enters("src/deep/er") and not reader.enters("docs")
    assert {p.prefix for p in reader.partitions()} == {"", "src", "src/deep", "src/deep/er"}


def test_two_filters_on_one_frame(spark, root):
    files = files_below(spark, str(root))
    one, other = files.filter("path = 'src/a.py'"), files.filter(F.col("name").startswith("x"))
    assert sorted(r.path for r in one.union(other).collect()) == ["docs/x.md", "src/a.py"]


def test_a_tree_has_a_partition_a_directory(spark, root):
    assert files_below(spark, str(root), contents=False).rdd.getNumPartitions() > 4
    assert {(p.prefix, p.deep) for p in tree.TreeReader({"path": str(root), "spread": "1"}).partitions()} == {("", True)}


def test_trees_of_nothing(spark, tmp_path):
    assert files_below(spark, str(tmp_path)).count() == 0
    assert files_below(spark, str(tmp_path / "none")).count() == 0


def test_changes_by_commit(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()

    def git(*args):
        subprocess.run(["git", "-C", str(work), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)

    def commit(**files):
        for name, text in files.items():
            file = work / name.replace("_", ".")
            file.unlink() if text is None else file.write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", "x")

    def told():
        query = changes_of(spark, str(work)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.path, r.change, None if r.content is None else bytes(r.content).decode()) for r in rows)

    git("init", "-q")
    commit(a_txt="1", b_txt="1")
    first = told()
    assert first == [("a.txt", "added", "1"), ("b.txt", "added", "1")]
    commit(a_txt="2", b_txt=None, c_txt="3")
    assert told() == sorted([*first, ("a.txt", "modified", "2"), ("b.txt", "deleted", None), ("c.txt", "added", "3")])


def test_a_scan_by_hadoop_gives_the_same(spark, root, monkeypatch):
    from corroba.operators.ignore import IgnoreRules
    from corroba.sources import files

    rules = IgnoreRules(("build/", "*.txt"))
    rows = lambda: sorted((r.path, r.parent, r.name, r.depth, r.extension, r.size_bytes, bytes(r.content)) for r in files.scan(spark, str(root), rules).collect())
    by_tasks = rows()
    monkeypatch.setattr(files, "opens", lambda _: False)
    assert by_tasks == rows() and len(by_tasks) == 6
    assert not tree.opens("viewfs://store/in")
