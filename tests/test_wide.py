import datetime as dt

import numpy as np

from intervallum.operators import wide

CATALOG = "concept_name string, family string, value_type string, common_unit string, min_possible double, max_possible double, paired_concept string, tolerance_minutes int"
T = dt.datetime(2014, 1, 1)


def catalog(spark):
    rows = [("B", "attribute", "boolean"), ("I", "attribute", "integer"), ("D", "attribute", "double"), ("S", "attribute", "string"), ("T", "attribute", "timestamp"), ("P", "pattern", "double")]
    return spark.createDataFrame([(n, f, t, None, None, None, None, None) for n, f, t in rows], CATALOG)


def cells(spark, output, scores):
    o = spark.createDataFrame(output, "row_id long, patient_id long, concept_name string, start_date_time timestamp_ntz, value string, abstraction_type string")
    s = spark.createDataFrame(scores, "row_id long, patient_id long, pattern_name string, start_date_time timestamp_ntz, compliance_type string, compliance_score double")
    return {(r.patient_id, r.attribute): r.cell for r in wide.cells_of(*wide.wide_patients(o, s, catalog(spark))).collect()}


def test_values(spark):
    texts = {"B": [(" Yes", "true"), ("0", "false"), ("maybe", None)], "I": [("2.0", "2"), ("02", "2"), ("+2", "2"), ("2.5", None), ("-3", "-3"), ("x", None)], "D": [("3,14", "3.1"), (" 1.25e+02", "125.0"), ("NaN", None), ("inf", None), ("-0.01", "0.0")], "S": [(" a b ", "a b"), ("N/A", None), ("?", None), ("", None)], "T": [("2014-01-02T03:04:05Z", "2014-01-02 03:04:05"), ("2014-13-01 00:00:00", None)]}
    rows, expected, n = [], {}, 0
    for concept, cases in texts.items():
        for value, cell in cases:
            n += 1
            rows.append((n, n, concept, T, value, "event"))
            if cell is not None:
                expected[n, concept] = cell
    assert cells(spark, rows, []) == expected


def test_latest_ties_and_nulls(spark):
    rows = [(3, 1, "S", T, "late b", "event"), (2, 1, "S", T, "late a", "context"), (1, 1, "S", None, "oldest", "event"), (9, 1, "S", T + dt.timedelta(1), "?", "event"), (5, 2, "S", None, "only", "event"), (6, None, "S", T, "x", "event"), (7, 3, "S", T, "x", "state"), (8, 3, None, T, "x", "event"), (10, 3, "S", T, None, "event")]
    scores = [(1, 1, "P", T, "TimeConstraint", 0.25), (2, 1, "P", T, "TimeConstraint", 0.5), (3, 1, "?", T, "TimeConstraint", 0.5), (4, 1, "P", T, None, 1.0), (5, 1, "P", T, "ValueConstraint", 1.5), (6, 4, "P", T, "ValueConstraint", float("nan"))]
    assert cells(spark, rows, scores) == {(1, "S"): "late a", (2, "S"): "only", (1, "P|TimeConstraint"): "0.250", (1, "P"): "1.000"}


def test_empty_and_names(spark):
    assert cells(spark, [], []) == {}
    c = spark.createDataFrame([(1, "a", "x"), (1, "A", "y"), (2, "patient_id", "z")], "patient_id long, attribute string, cell string")
    attributes = [wide.Attribute("a", "string"), wide.Attribute("A", "string"), wide.Attribute("patient_id", "string")]
    got = wide.pivot_balanced(c, attributes)
    assert got.columns == ["patient_id", "a", "_A", "_patient_id"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", "y", None), (2, None, None, "z")]


def test_one_exchange(spark):
    """However many attributes, one shuffle brings the cells together."""
    c = spark.createDataFrame([(i, f"a{i % 20}", "x") for i in range(200)], "patient_id long, attribute string, cell string")
    df = wide.pivot_balanced(c, [wide.Attribute(f"a{i}", "string") for i in range(20)])
    assert df.count() == 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_blocks_against_pivot(spark):
    """Blocks of every size give what a plain pivot gives; entities lie across blocks, some attributes are in few of them."""
    rng = np.random.default_rng(8)
    rows = sorted({(int(e), f"a{k}") for e, k in zip(rng.integers(0, 90, 900), (rng.random(900) ** 2 * 13).astype(int))})
    kinds = ["string", "integer", "double", "boolean", "timestamp", "score"]
    text = {"string": "s{}", "integer": "{}", "double": "{}.5", "boolean": "true", "timestamp": "2014-01-01 00:00:{:02d}", "score": "0.{}"}
    at = [wide.Attribute(f"a{k}", kinds[k % 6]) for k in range(14)]
    kind = {a.name: a.kind for a in at}
    data = [(f"p{e}", a, text[kind[a]].format(e % 60)) for e, a in rows]
    df = spark.createDataFrame(data, "who string, attribute string, cell string")
    expected = {}
    for e, a, c in data:
        expected.setdefault(e, {})[a] = c
    for size in (1, 7, 100_000):
        got = {r.who: r.asDict() for r in wide.pivot_balanced(df, at, "who", size).collect()}
        assert got.keys() == expected.keys()
        for e, row in got.items():
            there = {a: v for a, v in row.items() if a != "who" and v is not None}
            assert there.keys() == expected[e].keys()
            for a, v in there.items():
                c = expected[e][a]
                assert v == {"string": str, "integer": int, "double": float, "score": float, "boolean": lambda x: x == "true", "timestamp": lambda x: dt.datetime.fromisoformat(x)}[kind[a]](c)
