import datetime as dt

import numpy as np
import pandas as pd

from intervallum.operators import units

T = dt.datetime(2014, 1, 1)
ROWS = "row_id long, patient_id long, concept_name string, start_date_time timestamp_ntz, value string, unit string, source_id string, x double, y string"


def catalogs(spark):
    c = spark.createDataFrame([("G_MEASURE", "measure", "mg/dL", 10.0, 1500.0), ("K_MEASURE", "measure", "mmol/L", 1.0, 12.0), ("N_MEASURE", "measure", "/min", None, None), ("BOLUS", "dose", "U", None, None)], "concept_name string, family string, common_unit string, min_possible double, max_possible double")
    u = spark.createDataFrame([("G_MEASURE", "mg/dL", 1.0, 0.0), ("G_MEASURE", "mmol/L", 18.0, 0.0), ("K_MEASURE", "mmol/L", 1.0, 0.0), ("K_MEASURE", "mEq/L", 1.0, 0.0), ("N_MEASURE", "/min", 1.0, 0.0)], "concept_name string, unit_code string, factor double, shift double")
    return c, u


def sample(spark, extra=()):
    rng = np.random.default_rng(1)
    rows, n = [], 1000
    for source, unit in (("a", "mg/dL"), ("b", "mmol/L"), ("c", None), ("d", None)):
        for _ in range(60):
            n += 1
            mg = rng.normal(160, 20)
            mmol = unit == "mmol/L" or source == "d"
            rows.append((n, 1, "G_MEASURE", T, f"{mg / 18:.2f}" if mmol else f"{mg:.1f}", unit, source, 0.0, ""))
    return spark.createDataFrame(rows + list(extra), ROWS)


def test_named_units(spark):
    c, u = catalogs(spark)
    values = [(1, "5,5 mM", "mg/dL"), (2, "99", "mg per dL"), (3, "5.5mmol/l", None), (4, "HI", "mmol/L"), (5, None, "mmol/L"), (6, "2000", "mg/dL"), (7, "1e2", " MG/DL "), (8, "5.5 furlongs", "mg/dL"), (9, "", None), (10, "9" * 5000, "mg/dL"), (11, "5.5 mmol/L", "mg/dL")]
    rows = [(i, None, "G_MEASURE", None, v, unit, "a", 0.0, "") for i, v, unit in values] + [(20, 1, "K_MEASURE", T, "4.5", "mEq/L", None, 0.0, ""), (21, 1, "K_MEASURE", T, "4.5", None, None, 0.0, ""), (22, 1, "N_MEASURE", T, "80", "bpm", "a", 0.0, ""), (23, 1, None, T, "5", "mmol/L", "a", 0.0, ""), (24, 1, "BOLUS", T, "5", "U", "a", 0.0, "")]
    df = sample(spark, rows)
    got = {r.row_id: r for r in units.harmonise(df, c, u, ["row_id"]).where("row_id < 100").collect()}
    assert sorted(got) == [1, 2, 3, 6, 7, 8, 11, 20, 21, 22]
    assert got[8].review and got[8].y is None and got[8].unit_code is None
    assert abs(got[1].y - 99) < 1e-9 and got[2].y == 99 and got[7].y == 100
    assert got[21].unit_code == "mmol/L" and not got[21].named
    found = {(r.row_id, r.unit_code) for r in units.foreign_units(df, c, u).where("row_id < 100").collect()}
    assert found == {(1, "mmol/L"), (3, "mmol/L"), (11, "mmol/L"), (20, "mEq/L")}


def test_unnamed_units(spark):
    c, u = catalogs(spark)
    got = units.harmonise(sample(spark), c, u, ["row_id"]).where("not named").collect()
    assert {(r.source_id, r.unit_code, r.review) for r in got} == {("c", "mg/dL", False), ("d", "mmol/L", False)}


def test_nothing_is_converted_on_a_guess(spark):
    """One named unit only, a unit text that the concept doesn't have, and no named unit at all."""
    c, u = catalogs(spark)
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for source, unit, level in (("a", "mg/dL", 160), ("c", None, 160), ("d", None, 8.7), ("e", None, 60)):
        for _ in range(80):
            n += 1
            rows.append((n, 1, "G_MEASURE", T, f"{rng.normal(level, level / 8):.1f}", unit, source, 0.0, ""))
    odd = [(1001, 1, "G_MEASURE", T, "160", "furlongs", "c", 0.0, ""), (1002, 1, "G_MEASURE", T, "160", "see value", "c", 0.0, ""), (1003, 1, "G_MEASURE", T, "9 furlongs", "mg/dL", "c", 0.0, "")]
    got = units.harmonise(spark.createDataFrame(rows + odd, ROWS), c, u, ["row_id"]).toPandas().set_index("row_id")
    assert got.loc[1001].review and got.loc[1003].review and got.loc[[1001, 1003]].y.isna().all() and got.loc[[1001, 1003]].probability.isna().all()
    assert got.loc[1002].unit_code == "mg/dL" and not got.loc[1002].review
    d = got[got.source_id == "d"]  # nobody names mmol/L: the converted readings of source a say so
    assert (d.review | (d.unit_code == "mmol/L")).all() and not ((d.unit_code == "mg/dL") & ~d.review).any()
    nobody = [(i, 1, "G_MEASURE", T, f"{8 + i / 100:.2f}", None, "x", 0.0, "") for i in range(50)]
    got = units.harmonise(spark.createDataFrame(nobody, ROWS), c, u, ["row_id"]).toPandas()
    assert got.review.all() and got.probability.isna().all() and units.foreign_units(spark.createDataFrame(nobody, ROWS), c, u).count() == 0


def test_every_unit_keeps_its_labels():
    """Fitting takes its cells per unit: a rare unit is learned beside any number of cells of a common one."""
    cells = pd.DataFrame({"concept_name": "G", "source_id": "a", "unit_code": ["mg/dL"] * 3000 + ["mmol/L"] * 5, "level": [2.2] * 3000 + [0.9] * 5, "magnitude": [*np.random.default_rng(2).normal(2.2, 0.05, 3000), 0.88, 0.9, 0.91, 0.93, 0.95], "decimals": 1, "n": 1.0})
    forest = units.fit_forests(cells, {"G": {"mg/dL": (1.0, 0.0), "mmol/L": (18.0, 0.0)}})["G"]
    assert forest.predict(np.array([[0.9, 0.9, 1.0]]))[0, 1] > 0.8


def test_empty(spark):
    c, u = catalogs(spark)
    assert units.foreign_units(spark.createDataFrame([], ROWS), c, u).count() == 0
    assert units.foreign_units(sample(spark), c, u.limit(0)).count() == 0


def test_forest_is_calibrated():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    x = np.column_stack([rng.normal(y * 2.0, 1.0), rng.normal(0, 1, 4000)])
    f = units.Forest(2).fit(x[:2000], y[:2000], np.ones(2000)).calibrate(x[2000:3000], y[2000:3000], np.ones(1000))
    p = f.predict(x[3000:])[:, 1]
    assert ((p > 0.5) == y[3000:]).mean() > 0.8
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):
        m = (p >= lo) & (p < hi)
        assert abs(p[m].mean() - y[3000:][m].mean()) < 0.08
