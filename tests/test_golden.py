"""Published results of a table of 30 runs, from FIXTURES.md."""

import csv
import io
import re
from pathlib import Path

import pytest

from tessera.operators import designs
from tessera.operators import statistics as st


@pytest.fixture(scope="module")
def runs(spark):
    text = (Path(__file__).parents[1] / "FIXTURES.md").read_text()
    rows = list(csv.DictReader(io.StringIO(re.search(r"```csv\n(.*?)```", text, re.S)[1])))
    return spark.createDataFrame([(r["budget"], r["arm"], int(r["seed"]), float(r["recall"]), float(r["recall_small"]), float(r["mAP50"])) for r in rows], "budget string, arm string, seed int, recall double, small double, map50 double").cache()


def summary(runs, measure, names):
    v = st.contrast_values(runs.withColumnRenamed(measure, "value"), designs.contrasts(runs.sparkSession, names), ["budget", "arm"])
    return {r.contrast: r for r in st.verdict_by_intervals(st.intervals(st.contrast_summary(v))).collect()}


def test_contrasts_of_recall(runs):
    s = summary(runs, "recall", list(designs.CONTRASTS))
    want = {"P11": (-0.431797, 1.162752, 0.453010), "P12": (-0.215899, 0.581376, 0.453010), "P13": (1.236887, 2.304794, 0.296350), "F2d": (-1.668684, 2.230119, 0.169616)}
    for name, (mean, sd, p) in want.items():
        assert (s[name]["mean"], s[name].sd, s[name].p) == pytest.approx((mean, sd, p), abs=2e-6)
    assert (s["P11"].p_equivalent, s["P11"].lo95, s["P11"].hi95) == pytest.approx((0.167961, -1.875544, 1.011950), abs=2e-6)
    assert s["P12"].p_equivalent == pytest.approx(0.019663, abs=2e-6) and s["P12"].verdict == "equivalent"
    assert s["P11"].verdict == "inconclusive" and s["P11"].underpowered and s["F2d"].verdict == "inconclusive"


def test_contrasts_of_other_measures(runs):
    a, b = summary(runs, "small", ["P11"])["P11"], summary(runs, "map50", ["P11"])["P11"]
    assert (a["mean"], a.p, a.p_equivalent) == pytest.approx((-1.365462, 0.066063, 0.730734), abs=2e-6)
    assert (b["mean"], b.p, b.lo95) == pytest.approx((-0.663475, 0.003501, -0.961969), abs=2e-6)
    assert b.verdict == "worse" and b.also_within_margin


def test_holm(spark):
    p = spark.createDataFrame([("F1", "P11", 0.453010), ("F1", "P12", 0.453010), ("F1", "P13", 0.296350), ("F2", "a", 0.066063), ("F2", "b", 0.003501), ("F2", "d", 0.169616)], "family string, name string, p double")
    got = {r.name: r.p_holm for r in st.holm(p, "family", "name").collect()}
    assert got == pytest.approx({"P11": 0.906021, "P12": 0.906021, "P13": 0.889050, "a": 0.132125, "b": 0.010503, "d": 0.169616}, abs=2e-6)


def test_anova(runs):
    got = {r.term: r for r in st.anova(runs, "budget", "arm", "seed", "recall").collect()}
    want = {"budget": (16.972302, 1, 6.291991, 0.020857), "arm": (5.951143, 2, 1.103107, 0.351200), "budget:arm": (7.075374, 2, 1.311495, 0.291608), "seed": (8.258479, 4, 0.765398, 0.560157)}
    for term, values in want.items():
        assert (got[term].ss, got[term].df, got[term].f, got[term].p) == pytest.approx(values, abs=2e-6)
    assert got["error"].ss == pytest.approx(53.948907, abs=2e-6) and got["error"].df == 20
