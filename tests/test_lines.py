from intervallum.operators import lines

GOOD = "1,GLUCOSE_MEASURE,2014-01-01 10:00:00,2014-01-01 10:00:01,5.5,mg/dL"
CASES = {
    GOOD: None,
    ' "1" , "GLUCOSE_MEASURE" ,2014-01-01T10:00,2014-01-01 10:00:01.250Z, +1.5e2 ,"a, ""b"""': None,
    "1,MEAL,2016-02-29 23:59:59+02:00,2016-02-29 23:59:59-05:00,Soup,": None,
    "1,MEAL,2015-02-29 10:00:00,2014-01-01 10:00:01,x,": "bad_start",
    "1,MEAL,2014-04-31 10:00:00,2014-01-01 10:00:01,x,": "bad_start",
    "1,MEAL,1900-02-29 10:00:00,2014-01-01 10:00:01,x,": "bad_start",
    "1,MEAL,2000-02-29 10:00:00,2014-01-01 24:00:00,x,": "bad_end",
    "1,MEAL,2014-01-01 10:00:00,2014-01-01 10:60:00,x,": "bad_end",
    "1,MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,,": "bad_value",
    '1,MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,"  ",': "bad_value",
    "1,X_DOSAGE,2014-01-01 10:00:00,2014-01-01 10:00:01,1.5mg,": "bad_value",
    "1,X_DOSAGE,2014-01-01 10:00:00,2014-01-01 10:00:01,inf,": "bad_value",
    "1,X_DOSAGE,2014-01-01 10:00:00,2014-01-01 10:00:01,1e999,": "bad_value",
    "1,X_DOSAGE,2014-01-01 10:00:00,2014-01-01 10:00:01,.5,": None,
    "1.5,MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,x,": "bad_patient_id",
    ",,,,,": "bad_patient_id",
    "1, ,bad,bad,,": "empty_concept",
    '1,"",2014-01-01 10:00:00,2014-01-01 10:00:01,x,': "empty_concept",
    "1,MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,x": "column_count",
    "1,MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,x,,": "column_count",
    '1,ME"AL,2014-01-01 10:00:00': "quoting",
    '1,"MEAL,2014-01-01 10:00:00,2014-01-01 10:00:01,x,': "quoting",
    '1,"MEAL"x,2014-01-01 10:00:00,2014-01-01 10:00:01,x,': "quoting",
}


def test_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "line_id long, line_text string")
    good, bad = lines.split_lines(df)
    got = {r.line_text: r.reason for r in bad.collect()}
    assert got == {t: r for t, r in CASES.items() if r}
    assert {r.line_text for r in good.collect()} == {t for t, r in CASES.items() if r is None}


def test_no_records_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "PatientId,ConceptName"), (5, 'PATIENTID,"x'), (6, ' "patientid" ,a'), (7, GOOD), (7, GOOD)]
    df = spark.createDataFrame([(a, b, "keep", "old") for a, b in rows], "line_id long, line_text string, reason string, record string")
    good, bad = lines.split_lines(df)
    assert bad.count() == 0
    assert [r.line_id for r in good.collect()] == [7, 7]


def test_typed_record(spark):
    text = ' "1" , "A ""b""" ,2014-01-01T10:00+02:00,2014-01-01 10:00:01.250Z, x ,'
    r = lines.split_lines(spark.createDataFrame([(1, text)], "line_id long, line_text string"))[0].first().record
    assert (r.patient_id, r.concept_name, r.value, r.unit) == (1, 'A "b"', "x", None)
    assert str(r.start_date_time) == "2014-01-01 08:00:00" and str(r.end_date_time) == "2014-01-01 10:00:01.250000"


def test_long_lines_and_empty_table(spark):
    long_ = '1,"' + '""' * 200_000 + '",2014-01-01 10:00:00,2014-01-01 10:00:01,' + "y" * 300_000 + ","
    broken = "1," + '"' * 100_001 + ",2014-01-01 10:00:00"
    df = spark.createDataFrame([(1, long_), (2, broken)], "line_id long, line_text string")
    good, bad = lines.split_lines(df)
    assert [r.line_id for r in good.select("line_id").collect()] == [1]
    assert [(r.line_id, r.reason) for r in bad.select("line_id", "reason").collect()] == [(2, "quoting")]
    assert lines.split_lines(df.limit(0))[1].count() == 0
