"""The repository source: what the driver opens, what executors walk, and filters on names."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

from symgraph.sources import repository
from symgraph.sources.repository import _FilteringReader, _Reader, known, spread, walk


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree") / "repo"
    for i in range(12):
        for j in range(3):
            folder = at / f"d{i}" / ("node_modules" if j == 2 else f"e{j}") / "deep" / ".hid"
            folder.mkdir(parents=True)
            for k, name in enumerate(["a.py", "b.rs", "_c.go", "note.unknown", "Cargo.toml"]):
                (folder.parents[k % 4] / name).write_text(f"{i} {j} {k}")
    (at / "top.py").write_text("top")
    os.symlink(at / "d0", at / "link")
    return str(at)


@pytest.mark.parametrize("folders", [0, 1, 5, 64, 10_000])
@pytest.mark.parametrize("skip", [True, False])
def test_spread_finds_what_a_walk_finds(repo, folders, skip):
    files, left = spread(repo, skip, folders)
    found = files + [p for x in left for p in walk(x, skip)]
    assert sorted(found) == sorted(walk(repo, skip)) and len(found) == len(set(found)) > 40
    assert spread(os.path.join(repo, "d0", "node_modules")) == ([], [])


def test_the_driver_opens_few_folders(repo, monkeypatch):
    opened = []
    scandir = os.scandir
    monkeypatch.setattr(repository, "FOLDERS", 5)
    monkeypatch.setattr(repository.spread, "__defaults__", (True, 5))
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(p) or scandir(p))
    parts = _Reader({"path": repo}).partitions()
    assert len(opened) == 5 and opened[0] == repo and sum(p.folder is not None for p in parts) > 8


def test_rows_are_those_of_a_walk(spark, repo):
    got = {r["path"]: r["source"] for r in repository.files(spark, repo).collect()}
    assert set(got) == {p for p in walk(repo) if known(os.path.basename(p))} and got[f"{repo}/top.py"] == "top"
    assert repository.manifests(spark, repo).count() == sum(p.endswith("Cargo.toml") for p in walk(repo, False))


def test_filters_on_names(spark, repo):
    r = _FilteringReader({"path": repo})
    rest = list(r.pushFilters([EqualTo(("path",), "x"), StringEndsWith(("path",), ".py"), GreaterThan(("path",), "a"), StringContains(("source",), "1"), In(("path",), ("a", "b")), StringStartsWith(("path",), "/"), StringContains(("path",), "d1")]))
    assert rest == [GreaterThan(("path",), "a"), StringContains(("source",), "1")] and len(r.filters) == 5
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = repository._read(spark, path=repo)
        bad = os.path.join(repo, "d3", "bad.go")
        with open(bad, "wb") as f:
            f.write(b"\xff\xfe")  # is never read
        got = df.where(F.col("path").endswith(".rs") & F.col("path").contains("/d1/") & (F.length("source") > 2))
        assert {x["path"] for x in got.collect()} == {p for p in walk(repo) if p.endswith(".rs") and "/d1/" in p}
    finally:
        os.remove(bad)
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
