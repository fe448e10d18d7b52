import datetime as dt
import itertools

import numpy as np
import pandas as pd

from intervallum.operators import fill

T = dt.datetime(2014, 1, 1)
SCORES = "row_id long, patient_id long, pattern_name string, start_date_time timestamp_ntz, end_date_time timestamp_ntz, compliance_type string, compliance_score double"


def catalog(spark):
    return spark.createDataFrame([("P", "pattern"), ("Q", "pattern"), ("M", "measure")], "concept_name string, family string")


def test_dependency_and_groups(spark):
    rows = [(i, "a" if i % 3 else "b", f"v{i % 3}") for i in range(90)] + [(100, "a", None), (101, "b", None), (102, None, None)]
    df = spark.createDataFrame([(i, k, i % 3 if i < 100 else 1, v) for i, k, v in rows], "id int, k string, d int, v string")
    found = fill.mine(df.where("v is not null"), "v", ["k", "d"], holds=0.95)
    assert [(f.by, f.holds) for f in found] == [(("d",), 1.0)]  # k+d holds as well, but is no minimal determinant
    got = {r.id: (r.v, r.v_from) for r in fill.fill(df, "v", ["k", "d"], [("k",), ()], holds=0.95).where("id >= 100").collect()}
    assert got == {100: ("v1", "fd:d"), 101: ("v1", "fd:d"), 102: ("v1", "fd:d")}
    got = {r.id: (r.v, r.v_from) for r in fill.fill(df, "v", [], [("k",), ()]).where("id >= 100").collect()}
    assert got[101] == ("v0", "group:k") and got[100][1] == "group:k" and got[102][1] == "group:all"


def test_scores(spark):
    e = T + dt.timedelta(hours=1)
    rows = [(i, i % 5, "P" if i % 5 < 3 else "Q", T + dt.timedelta(days=i % 5), e + dt.timedelta(days=i % 5), ("TimeConstraint", "ValueConstraint")[i % 2], 0.5) for i in range(100)]
    rows += [(200, 1, None, T + dt.timedelta(days=1), e + dt.timedelta(days=1), "TimeConstraint", 0.5), (201, 4, "M", T + dt.timedelta(days=4), e + dt.timedelta(days=4), "ValueConstraint", None), (202, None, "", None, None, None, float("nan")), (202, None, "", None, None, None, 2.0), (203, 9, "P", None, T, "x", -1.0)]
    got = fill.repaired_scores(spark.createDataFrame([(*r, "clash") for r in rows], SCORES + ", pattern_name_from string"), catalog(spark))
    by = {}
    for r in got.collect():
        by.setdefault(r.row_id, []).append(r)
    assert len(got.collect()) == len(rows)
    assert by[200][0].pattern_name == "P" and by[200][0]["_pattern_name_from"].startswith("fd:")
    assert by[201][0].pattern_name == "Q" and by[201][0].compliance_score == 0.5
    assert len(by[202]) == 2 and all(r.pattern_name and r.compliance_score is not None for r in by[202])
    assert by[203][0].compliance_score_from == "fd:pattern_name"  # every score here is 0.5
    assert by[203][0]["_pattern_name_from"] is None
    assert by[0][0].compliance_score_from is None


def test_mined_levels_against_brute_force(spark):
    """Minimal determinants of up to three columns, as a plain search over all sets finds them."""
    rng = np.random.default_rng(3)
    x = pd.DataFrame({c: rng.integers(0, n, 3000) for c, n in (("a", 6), ("b", 5), ("c", 4), ("e", 3))})
    x["t"] = (x.a * 7 + x.b * 3 + (x.c > 1)) % 11
    x["u"] = x.e * 2
    x["u"] = np.where(rng.random(3000) < 0.03, 9, x.u)

    def brute(target, levels):
        out = []
        for size in range(1, levels + 1):
            for by in itertools.combinations("abce", size):
                n = x.groupby([*by, target]).size().rename("n").reset_index().groupby(list(by)).n.agg(["sum", "max"])
                n = n[n["sum"] > 1]
                if n["sum"].sum() >= 50 and n["max"].sum() / n["sum"].sum() >= 0.9 and not any(set(o) <= set(by) for o in out):
                    out.append(by)
        return set(out)

    df = spark.createDataFrame(x)
    for target in "tu":
        assert {d.by for d in fill.mine(df, target, list("abce"), levels=3)} == brute(target, 3) != set()


def test_hidden_cells_come_back(spark):
    """Accuracy on known cells that were hidden: names by the evaluation they belong to, scores by their group."""
    rng = np.random.default_rng(5)
    rows, hidden = [], {}
    for i in range(600):
        patient, k = int(rng.integers(0, 20)), int(rng.integers(0, 40))
        name = "P" if (patient + k) % 2 else "Q"
        level = 0.9 if name == "P" else 0.2
        for kind in ("TimeConstraint", "ValueConstraint"):
            n, s = len(rows), float(np.clip(rng.normal(level, 0.03), 0, 1))
            hide = rng.random()
            if hide < 0.1:
                hidden[n] = name
            elif hide < 0.2:
                hidden[n] = s
            rows.append((n, patient, None if hide < 0.1 else name, T + dt.timedelta(days=k), T + dt.timedelta(days=k, hours=2), kind, None if 0.1 <= hide < 0.2 else s))
    got = {r.row_id: r for r in fill.repaired_scores(spark.createDataFrame(rows, SCORES), catalog(spark)).collect()}
    names = [got[i].pattern_name == v for i, v in hidden.items() if isinstance(v, str)]
    scores = [abs(got[i].compliance_score - v) for i, v in hidden.items() if not isinstance(v, str)]
    assert np.mean(names) > 0.9 and np.mean(scores) < 0.06
    assert {got[i].pattern_name_from.split(":")[0] for i, v in hidden.items() if isinstance(v, str)} >= {"fd"}


def test_none_is_not_filled(spark):
    """No row has a name or score to learn from: the cells stay empty, marked `none`, and are not listed."""
    got = fill.repaired_scores(spark.createDataFrame([(1, 1, None, T, T, "a", None)], SCORES), catalog(spark))
    r = got.first()
    assert (r.pattern_name, r.pattern_name_from, r.compliance_score, r.compliance_score_from) == (None, "none", None, "none")
    assert fill.filled_cells(got).count() == 0


def test_cells(spark):
    rows = [(1, 1, "P", T, T, "a", 0.5), (2, 1, "zz", T, T, "a", 0.5), (3, 1, None, T, T, "a", None), (3, 1, None, T, T, "a", None)]
    got = fill.filled_cells(fill.repaired_scores(spark.createDataFrame(rows, SCORES), catalog(spark)))
    assert sorted(map(tuple, got.collect())) == [(2, "pattern_name")] + [(3, "compliance_score")] * 2 + [(3, "pattern_name")] * 2
    assert fill.repaired_scores(spark.createDataFrame([], SCORES), catalog(spark)).count() == 0
