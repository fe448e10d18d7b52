"""Analytics queries against SQL over all their input."""

import inspect

from intervallum.functions import stats
from intervallum.queries import analytics
from intervallum.queries.rounding import six_sql
from tests.oracle import compare, connection

_ALL = f"""with {analytics._ASP}, nm as (select distinct concept_name as pattern_name from concept_catalog where family = 'pattern'),
k as (select patient_id, complication, pattern_name, avg(avg_score) as s from asp join nm on starts_with(aspect, pattern_name || '__') group by all),
z as (select patient_id, complication, avg(s) as s from k group by all)
select lab.patient_id, lab.complication, round(s, 6) as total_adherence from lab left join z on z.patient_id = lab.patient_id and z.complication = lab.complication"""


def test_aspect_totals_of_all_patterns_and_types(spark, sf_dir):
    compare(spark, sf_dir, analytics.aspect_totals, six_sql(_ALL))


def test_feature_table_has_every_aspect(spark, sf_dir):
    got = analytics._features(spark, sf_dir)[1]
    expected = connection(sf_dir).execute("select distinct concept_name || '__' || compliance_type from concept_catalog, patient_qa_scores where family = 'pattern' and compliance_type is not null").fetchall()
    assert sorted(got) == sorted(x for (x,) in expected)


def test_bootstrap_signs_takes_the_operators_resamples(spark, sf_dir, monkeypatch):
    signature, calls = inspect.signature(stats.sign_stability), []
    monkeypatch.setattr(stats, "sign_stability", lambda *args, **kw: calls.append(signature.bind(*args, **kw)))
    analytics.bootstrap_signs(spark, sf_dir)
    calls[0].apply_defaults()
    assert calls[0].arguments["resamples"] == 50
