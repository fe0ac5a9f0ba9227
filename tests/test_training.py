import hashlib
import json

import pytest

from tessera.operators import designs, gates
from tessera.sources import manifests, training


def paths(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "path string")


def test_arms_are_prepared(spark, tmp_path):
    arms = designs.arms(spark.createDataFrame([("C", 0.0), ("M", 0.5)], "arm string, fraction double"), 8, 2)
    out = training.prepare_arms(paths(spark, "r1", "r2"), {"M": paths(spark, "s1", "s2", "s3", "s4")}, arms, "path", str(tmp_path), "val", ["ship"], batch=3)
    assert sorted(map(tuple, out.collect())) == [("C", 8, 0, 8, 1.0, 3), ("M", 4, 4, 8, 0.5, 3)]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/lists/M").collect()]
    assert sorted(lines) == ["r1"] * 2 + ["r2"] * 2 + ["s1", "s2", "s3", "s4"]
    assert (tmp_path / "configs" / "M.yaml").read_text() == f"train: {tmp_path}/lists/M\nval: val\nnc: 1\nnames:\n  - ship\n"
    assert {r["arm"]: r["n_total"] for r in json.loads((tmp_path / "configs" / "counts.json").read_text())} == {"C": 8, "M": 8}
    with pytest.raises(gates.Refused, match="planned 4"):
        training.prepare_arms(paths(spark, "r1", "r2"), {}, arms, "path", str(tmp_path / "x"), "val", ["ship"])
    assert not (tmp_path / "x").exists()


def test_copied_files(spark, tmp_path):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "a" / "x.csv").write_bytes(b"12")
    (tmp_path / "a" / "b c" / "y.bin").write_bytes(b"")
    for _ in range(2):  # a second copy replaces the first
        rows = training.copied(spark, str(tmp_path / "a"), str(tmp_path / "z")).collect()
    assert sorted(map(tuple, rows)) == [("b c/y.bin", 0, hashlib.sha256().hexdigest()), ("x.csv", 2, hashlib.sha256(b"12").hexdigest())]
    assert sorted(str(p.relative_to(tmp_path / "z")) for p in (tmp_path / "z").rglob("*") if p.is_file() and p.suffix != ".crc") == ["b c/y.bin", "x.csv"]
    assert (tmp_path / "z" / "x.csv").read_bytes() == b"12"
    assert [r.name for r in training.copied(spark, str(tmp_path / "a"), str(tmp_path / "csv"), "*.csv").collect()] == ["x.csv"]
    found = {r.path.rsplit("/", 1)[-1]: (r.length, r.md5) for r in manifests.file_hashes(spark, str(tmp_path / "a")).collect()}
    assert found == {"y.bin": (0, hashlib.md5().hexdigest()), "x.csv": (2, hashlib.md5(b"12").hexdigest())}


def test_environment(spark):
    a = training.environment(spark, packages=("numpy", "no-such-package"), probe=lambda: {"gpu": "none"})
    seen = a.first().environment
    assert seen["spark"] == spark.version and seen["gpu"] == "none" and "numpy" in seen and "no-such-package" not in seen
    b = spark.createDataFrame([(seen | {"numpy": "0"},)], "other map<string, string>")
    diff = a.join(b).select(gates.map_differences("environment", "other").alias("d")).first().d
    assert list(diff) == ["numpy"] and diff["numpy"].is_now == "0"


def test_weights(spark):
    t = lambda *r: spark.createDataFrame(list(r), "k string, v array<double>")
    same = training.weights_compared(t(("a", [1.0]), ("b", None)), t(("b", None), ("a", [1.0])), "k", "v").first()
    assert tuple(same) == (True, None, 2, 0, [])
    assert tuple(training.weights_compared(t(("a", [1.0]), ("b", None)), t(("a", [1.5]), ("b", [])), "k", "v").first()) == (False, None, 2, 2, ["a", "b"])
    assert tuple(training.weights_compared(t(("a", [1.0])), t(("c", [1.0])), "k", "v").first()) == (False, "names differ", 1, None, None)
    assert tuple(training.weights_compared(t(("a", [1.0])).limit(0), t(("c", [1.0])).limit(0), "k", "v").first()) == (True, None, 0, 0, [])
