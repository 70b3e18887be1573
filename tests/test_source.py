import os

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from siltstone import config
from siltstone.sources import repo
from siltstone.sources.repo import RepoDataSource, Tree, iter_files, list_repo, read_repo, stream_repo

ALL = config.DEFAULTS["indexing"] | {"include_globs": ["*"], "exclude_globs": ["**/target/**", "*.skip"]}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    for i in range(60):
        p = root / f"d{i % 7}" / f"e{i % 3}" / f"f{i}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * i)
    for name in ("top.txt", "target/no.txt", "d1/target/no.txt", ".hid/a.txt", "d2/x.skip"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    os.symlink(root / "d1", root / "d2" / "link")
    os.symlink(root, root / "d3" / "loop")
    return root


def _walked(root, follow=False):
    """Every file by a plain walk that does not enter a folder twice on one way down."""
    out = set()

    def down(folder, above):
        real = os.path.realpath(folder)
        if real in above:
            return
        for name in os.listdir(folder):
            p = os.path.join(folder, name)
            if os.path.isdir(p):
                if name != "target" and (follow or not os.path.islink(p)):
                    down(p, (*above, real))
            elif not name.endswith(".skip") and (follow or not os.path.islink(p)):
                out.add(os.path.relpath(p, root))

    down(str(root), ())
    return out


@pytest.mark.parametrize("follow", [False, True])
@pytest.mark.parametrize("folders", [1, 5, 256])
def test_listing_equals_a_plain_walk(spark, tree, monkeypatch, follow, folders):
    monkeypatch.setattr(repo, "FOLDERS", folders)
    want = _walked(tree, follow)
    got = [r.relpath for r in list_repo(spark, str(tree), ALL, follow_symlinks=follow).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {os.path.relpath(p, tree) for p in iter_files(str(tree), ["*"], ALL["exclude_globs"], follow_symlinks=follow)} == want


def test_a_tree_behind_a_scheme(spark, tree):
    uri = f"file://{tree}"
    os.unlink(tree / "d3" / "loop")
    os.unlink(tree / "d2" / "link")
    got = {r.relpath: (r.size_bytes, r.content) for r in read_repo(spark, uri, ALL).collect()}
    assert got == {r.relpath: (r.size_bytes, r.content) for r in read_repo(spark, str(tree), ALL).collect()} and len(got) == 62
    assert read_repo(spark, f"{uri}/nowhere", ALL).count() == 0


def test_the_driver_enters_few_folders(tree, monkeypatch):
    entered = []
    real = Tree.enter
    monkeypatch.setattr(Tree, "enter", lambda self, f: entered.append(f.rel) or real(self, f))
    monkeypatch.setattr(repo, "FOLDERS", 4)
    reader = RepoDataSource({"path": str(tree)}).reader(_parse_datatype_string(repo.LISTED))
    work = reader.partitions()
    assert entered == [""] and {f.rel for w in work for f in w.folders} == {".hid", "target", *(f"d{i}" for i in range(7))} and sum(len(w.files) for w in work) == 1


def test_bytes_are_read_only_where_they_are_asked_for(tree, monkeypatch):
    opened = []
    real = Tree.read
    monkeypatch.setattr(Tree, "read", lambda self, rel, enc: opened.append(rel) or real(self, rel, enc))

    def run(columns, *filters):
        opened.clear()
        reader = RepoDataSource({"path": str(tree), "push_filters": "true"}).reader(_parse_datatype_string(columns))
        left = list(reader.pushFilters(list(filters)))
        return [row for w in reader.partitions() for row in reader.read(w)], left

    rows, _ = run("relpath string, size_bytes long")
    assert len(rows) == 65 and not opened
    rows, left = run("size_bytes long, content string", D.LessThan(("size_bytes",), 5), D.StringStartsWith(("relpath",), "d"), D.EqualTo(("content",), "x"), D.IsNotNull(("relpath",)))
    assert len(opened) == len(rows) == 5 and all(n == len(c) < 5 for n, c in rows) and len(left) == 1
    assert len(run("content string", D.In(("relpath",), ("top.txt", "none")))[0]) == len(opened) == 1


def test_filters_reach_the_source(spark, tree):
    held = spark.conf.get(repo.PUSH)
    spark.conf.set(repo.PUSH, "true")
    try:
        listed = list_repo(spark, str(tree), ALL).filter("size_bytes >= 58 AND relpath LIKE 'd%'")
        assert {r.relpath for r in listed.collect()} == {"d2/e1/f58.txt", "d3/e2/f59.txt"}
        assert "size_bytes" in listed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(repo.PUSH, held)


def test_files_are_dealt_by_size(spark, tree, monkeypatch):
    monkeypatch.setattr(repo, "TASK_BYTES", 100)
    files = read_repo(spark, str(tree), ALL)
    assert files.count() == 62 and files.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 5


def test_stream_of_new_and_changed_files(spark, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    put = lambda name, text, at: ((root / name).write_text(text), os.utime(root / name, (at, at)))
    got = []

    def run():
        got.clear()
        q = stream_repo(spark, str(root), ALL, settle=0).writeStream.foreachBatch(lambda b, _: got.extend((r.relpath, r.content) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(got)

    put("a", "1", 1000)
    put("b", "1", 1000)
    put("x.skip", "1", 1000)
    assert run() == [("a", "1"), ("b", "1")]
    assert run() == []
    put("b", "2", 2000)
    put("c", "1", 1500)
    assert run() == [("b", "2"), ("c", "1")]  # each run is a restart from the checkpoint
    assert run() == []
