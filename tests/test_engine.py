import datetime as dt

import pytest

from intervallum.plans import model as M
from intervallum.plans.engine import Abstraction, records_of
from intervallum.plans.knowledge import KnowledgeBase
from intervallum.queries import abstraction as Q
from intervallum.sources import records as R
from intervallum.sources import store

T = dt.datetime(2014, 1, 1)
INPUT = "patient_id long, concept_name string, start_date_time timestamp_ntz, end_date_time timestamp_ntz, value string"


def small(spark):
    rows = [(1, "adm", T, None, "x"), (1, "glucose", T + dt.timedelta(hours=1), None, "50"), (1, "glucose", T + dt.timedelta(hours=2), None, "bad"), (2, "glucose", T, T, "200"), (None, "glucose", T, T, "1"), (3, None, T, T, "1"), (3, "glucose", None, T, "1")]
    return records_of(spark.createDataFrame(rows, INPUT))


def kb():
    g = M.RawConcept("G", concept_type="raw-numeric", attributes=(M.Attribute("glucose", "numeric", M.Bound(None, 0, 600)),))
    a = M.RawConcept("A", concept_type="raw-boolean", attributes=(M.Attribute("adm", "boolean"),))
    s = M.State("S", parent=M.Source("G", "raw-concept"), good_after=3600.0, rules=(M.Rule("Low", (M.Condition("", (M.Bound(None, None, 70),)),), "and"),))
    p = M.LocalPattern("P", derived=(M.Source("A", "raw-concept", 0, "A1"), M.Source("G", "raw-concept", 0, "E1")), rules=(M.LocalRule("before", (M.Condition("A1", (M.Bound("True"),)),), (M.Condition("E1", (M.Bound(None, 0),)),), max_distance=7200.0, time=M.Compliance(M.Trapezoid(0, 0, 7200, 7200, True))),))
    q = M.Event("Q", derived=(M.Source("P", "local-pattern", 0, "A1"),), rules=(M.Rule("Good", (M.Condition("A1", (M.Bound("True"),)),)),))
    return KnowledgeBase([q, p, s, a, g], (M.GlobalClipper("adm", "START"),))


def test_outputs_and_scores(spark):
    run = Abstraction(small(spark), kb(), cut_after=2)
    out = {(r.patient_id, r.concept_name): r.value for r in run.outputs(["S", "P"]).collect()}
    assert out == {(1, "S"): "Low", (1, "P"): "True"}
    assert [tuple(r)[:2] + (r.compliance_type, r.compliance_score) for r in run.scores().collect()] == [(1, "P", "TimeConstraint", 1.0)]
    assert set(run.trace("S")) == {"G", "S"}
    run.keep(["G"])
    assert {r.concept: r.rows for r in run.summary().collect()} == {"G": 2, "A": 1, "S": 1, "P": 1}
    run.release()
    with pytest.raises(ValueError):
        run.outputs(["G"])


def test_whole_knowledge_base_runs(spark, sf_dir):
    run = Q.run(spark, sf_dir)
    names = [n for n in Q.KB.order() if Q.KB.by_name[n].family in ("event", "state", "trend", "context")]
    key = ["patient_id", "concept_name", "start_date_time"]
    rows = run.outputs(names)
    assert rows.count() == rows.select(*key).distinct().count() > 0
    assert rows.where("end_date_time < start_date_time").count() == 0


def test_order_of_input_does_not_matter(spark, sf_dir):
    records = Q.event_records(spark, sf_dir)
    for name in ("VIEW_STATE_SMOOTH", "BUY_RULES"):
        a = sorted(map(str, Q.label_rows(Abstraction(records, Q.KB)[name]).collect()))
        b = sorted(map(str, Q.label_rows(Abstraction(records.orderBy("value"), Q.KB)[name]).collect()))
        assert a == b


def test_csv(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text('Patient ID,concept name,starttime,End,RESULT,extra\n1,G,2014-01-01T10:00:00+02:00,2014-01-01 10:00:00.5,"5, ""x""",q\n1,G,2014-01-01 08:00:00,2014-01-01 09:00,later,q\n2.0,H,2014-01-01,2014-01-02,7,\n')
    rows = {(r.patient_id, r.concept_name): r for r in R.read_csv(spark, str(f), {"patient_id": ["Patient ID"]}).collect()}
    assert len(rows) == 2 and rows[1, "G"].value == '5, "x"' and rows[1, "G"].unit is None
    assert str(rows[1, "G"].start_date_time) == "2014-01-01 08:00:00" and str(rows[1, "G"].end_date_time) == "2014-01-01 10:00:00"
    target = str(tmp_path / "t")
    assert R.load_csv(spark, str(f), target, mapping={"patient_id": ["Patient ID"]}).count() == 2
    assert R.load_csv(spark, str(f), target, mapping={"patient_id": ["Patient ID"]}).count() == 2
    with pytest.raises(R.LoadError, match="missing"):
        R.map_columns(["a", "b"])
    for bad in ("x,G,2014-01-01,2014-01-01,5", "1,,2014-01-01,2014-01-01,5", "1,G,2014-02-30,2014-01-01,5", "1,G,2014-01-01,never,5", "1,G,2014-01-01,2014-01-01,", "1.5,G,2014-01-01,2014-01-01,5"):
        f.write_text("PatientId,ConceptName,Start,End,Value\n1,G,2014-01-01,2014-01-01,5\n" + bad + "\n")
        with pytest.raises(R.LoadError):
            R.load_csv(spark, str(f), target)
    assert spark.read.parquet(target).count() == 2
    f.write_text("PatientId,ConceptName,Start,End,Value\n1,G,1814-01-01,2014-01-01,5\n")
    with pytest.warns(UserWarning, match="years away"):
        R.read_csv(spark, str(f))


def test_patients_and_scan(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a")], "patient_id long, concept_name string")
    assert R.patients(df).count() == 2 and R.patients(df, []).count() == 0
    with pytest.warns(UserWarning, match="not found"):
        assert [r.patient_id for r in R.patients(df, [2, 9]).collect()] == [2]
    assert R.scan(df, ["a"], R.patients(df, [1])).count() == 1


def test_store_and_rerun(spark, tmp_path):
    out, scores = str(tmp_path / "o"), str(tmp_path / "s")
    run = Abstraction(small(spark), kb())
    store.write_outputs(run.outputs(["S", "P", "Q"]), out)
    store.write_scores(run.scores(), scores)
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(scores).count() == 1
    wider = KnowledgeBase([*[d for n, d in kb().by_name.items() if n != "S"], M.State("S", parent=M.Source("G", "raw-concept"), good_after=3600.0, rules=(M.Rule("Any", (M.Condition("", (M.Bound(None, 0),)),), "and"),))])
    assert store.rerun(small(spark), wider, ["S"], out, scores) == ["S"]
    assert sorted((r.concept_name, r.value) for r in spark.read.parquet(out).collect()) == [("P", "True"), ("Q", "Good"), ("S", "Any"), ("S", "Any")]
    store.export_csv(spark.read.parquet(scores), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    assert [(r.concept, r.rows_in, r.rows_out) for r in store.failure_report(small(spark), Abstraction(small(spark), kb())).collect()] == [("G", 3, 2)]
    store.append_first(run.scores(), scores, store.SCORE_KEY, ["end_date_time"])
    assert spark.read.parquet(scores).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from intervallum.__main__ import main
    from tests.test_knowledge import EVENT, STATE
    from tests.test_knowledge import LOCAL, raw

    kb_dir = tmp_path / "kb"
    kb_dir.mkdir()
    for i, text in enumerate((raw(), EVENT, STATE, LOCAL)):
        (kb_dir / f"{i}.xml").write_text(text)
    (tmp_path / "in.csv").write_text("PatientId,ConceptName,Start,End,Value\n1,G,2014-01-01 00:00:00,2014-01-01 00:00:01,50\n1,G,2014-01-01 05:00:00,2014-01-01 05:00:01,90\n2,G,2014-01-01 00:00:00,2014-01-01 00:00:01,90\n")
    at = {k: str(tmp_path / k) for k in ("records", "outputs", "scores", "csv")}
    main(["load", str(tmp_path / "in.csv"), "--to", at["records"]], spark)
    common = ["--kb", str(kb_dir), "--records", at["records"], "--outputs", at["outputs"], "--scores", at["scores"]]
    main(["run", *common], spark)
    out = spark.read.parquet(at["outputs"])
    assert sorted((r.patient_id, r.concept_name, r.value) for r in out.collect()) == [(1, "E", "Hypo"), (1, "L", "True"), (1, "S", "Low")]
    assert spark.read.parquet(at["scores"]).count() == 1
    main(["run", *common, "--only", "E", "--patients", "2"], spark)
    main(["rerun", *common, "--changed", "E"], spark)
    main(["stats", at["records"]], spark)
    main(["coverage", "--kb", str(kb_dir), "--records", at["records"]], spark)
    main(["export", at["outputs"], "--to", at["csv"]], spark)
    main(["kb", str(kb_dir), "--json", str(tmp_path / "kb.json")], spark)
    assert "recomputed: E L" in capsys.readouterr().out and KnowledgeBase.from_json((tmp_path / "kb.json").read_text()).get("S")


def test_loaded_rows_keep_their_order(spark, tmp_path):
    """Ties of time follow the order of lines, also over several loads."""
    head = "PatientId,ConceptName,StartDateTime,EndDateTime,Value\n"
    for name, lines in (("a.csv", [5, 3, 9]), ("b.csv", [1, 5, 2])):
        (tmp_path / name).write_text(head + "".join(f"{p},C,2024-01-01 00:00:00,2024-01-01 00:00:01,x\n" for p in lines))
        table = R.load_csv(spark, str(tmp_path / name), str(tmp_path / "t"))
    assert [r.patient_id for r in table.orderBy("ord").collect()] == [5, 3, 9, 1, 2]
    assert [r.patient_id for r in records_of(table).orderBy("ord").collect()] == [5, 3, 9, 1, 2]


def test_failed_rerun_keeps_the_tables(spark, tmp_path, monkeypatch):
    out, scores = str(tmp_path / "o"), str(tmp_path / "s")
    store.write_outputs(Abstraction(small(spark), kb()).outputs(["S", "P", "Q"]), out)
    monkeypatch.setattr(Abstraction, "scores", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.rerun(small(spark), kb(), ["S", "P"], out, scores)
    assert spark.read.parquet(out).count() == 3
