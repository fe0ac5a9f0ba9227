import pytest

from tessera.operators.gates import Refused
from tessera.sources import labels, manifests


def test_metadata_of_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    manifests.write_with_metadata(df, str(tmp_path / "m"), {"seed": "42"})
    runs = manifests.write_with_metadata(df.limit(0), str(tmp_path / "m"), {"seed": "43"}, append=True).collect()
    assert sorted((r.config["seed"], r.n_rows) for r in runs) == [("42", 2), ("43", 0)] and all(r.started <= r.ended and r.seconds >= 0 for r in runs)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    with pytest.raises(Exception, match="exists"):
        manifests.write_with_metadata(df, str(tmp_path / "m"), {})


def test_vectors_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.25], "s"), (2, None, None)], "id bigint, v array<double>, source string")
    manifests.write_vectors(df, str(tmp_path / "v"), "id", "v")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [(1, [0.5, 0.25]), (2, None)]
    assert manifests.markdown_table(df.orderBy("id"), {"id": "d", "source": "s"}) == "| id | source |\n| - | - |\n| 1 | s |\n| 2 | - |\n"
    with pytest.raises(Refused):
        manifests.markdown_table(df, {"id": "d"}, most=1)


def test_places_of_csv_boxes(spark, tmp_path):
    head = "filename,width,height,class,xmin,xmax,ymin,ymax\n"
    (tmp_path / "a.csv").write_text(head + "x,1,1,s,5,6,0,1\ny,1,1,s,0,1,0,1\nx,1,1,s,3,4,0,1\nx,1,1,s,1,2,0,1\n")
    rows = labels.box_csv(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.filename, r.box_index, r.xmin) for r in rows) == [("x", 0, 5), ("x", 1, 3), ("x", 2, 1), ("y", 0, 0)]


def test_box_csv_of_many_rows_is_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Rows carry the place of their file, not its name, and are numbered in parts of bounded size."""
    from tessera.operators import bounds

    monkeypatch.setattr(bounds, "PART_ROWS", 10)
    at = str(tmp_path / "many")
    for i in range(2):
        rows = spark.range(100).selectExpr("concat('f', id % 5) filename", "1 width", "1 height", "'c' class", f"{i} xmin", "cast(id as int) xmax", "0 ymin", "1 ymax").coalesce(1)
        rows.write.option("header", True).csv(f"{at}/{i}")
    got = labels.box_csv(spark, f"{at}/*")
    exchange = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(filename" in x]
    assert len(exchange) == 1 and ", 20), REPARTITION_BY_NUM" in exchange[0]
    first = sorted((r.box_index, r.xmin, r.xmax) for r in got.where("filename = 'f0'").collect())
    assert first == [(k, k // 20, 5 * (k % 20)) for k in range(40)]


def test_an_archive_is_unpacked_by_many_tasks(spark, tmp_path, monkeypatch):
    """Runs of members, equal names in one run, empty and outer ones, and hashes of the files by their paths."""
    import hashlib
    import warnings
    import zipfile

    from tessera.sources import pools

    monkeypatch.setattr(pools, "TASK_MEMBERS", 3)
    rows = [(f"d{i % 2}/{i:02d}", b"x" * i) for i in range(20)] + [("d0/04", b"a"), ("d0/04", b"last"), ("../out", b"no"), ("d1/", b"")]
    with warnings.catch_warnings(), zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        warnings.simplefilter("ignore")
        for name, content in rows:
            z.writestr(name, content)
    (tmp_path / "none").mkdir()
    zipfile.ZipFile(tmp_path / "none" / "n.zip", "w").close()
    got = pools.unpack(spark, str(tmp_path / "a.zip"), str(tmp_path / "to"))
    assert got.rdd.getNumPartitions() >= 6
    got = got.collect()
    assert len(got) == 22 and not (tmp_path / "out").exists() and not (tmp_path / "to" / "out").exists()
    want = {name: content for name, content in rows[:22]}
    paths = spark.createDataFrame([(r.path,) for r in got], "path string").distinct()
    hashed = {r.path.split("a.zip/")[1]: (r.length, r.md5, r.sha256) for r in manifests.hashes_of(paths).collect()}
    assert hashed == {k: (len(v), hashlib.md5(v).hexdigest(), hashlib.sha256(v).hexdigest()) for k, v in want.items()}
    assert pools.unpack(spark, str(tmp_path / "none" / "n.zip"), str(tmp_path / "to")).count() == 0
