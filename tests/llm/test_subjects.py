import numpy as np
import pytest

from intervallum.llm import subjects
from intervallum.llm.queries import p10_found

TOPICS = {"law": "court plaintiff verdict appeal clause statute bailiff notary".split(), "sport": "goal striker league referee marathon hurdle podium relay".split(), "food": "garlic oven broth dough whisk saffron ladle pastry".split(), "software": "merge release build lockfile compiler daemon commit branch".split()}
COMMON = "row value total name list group index state label update before after".split()


def tables(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    docs, truth = [], {}
    names = list(TOPICS)
    for i in range(n):
        own = [names[i % 4]] if i % 7 or i % 4 == 3 else [names[i % 4], names[(i + 1) % 3]]
        own = list(dict.fromkeys(own))
        words = [w for s in own for w in rng.choice(TOPICS[s], 14)] + list(rng.choice(COMMON, 20))
        if i % 5 == 0 and own != ["software"]:
            words.append(str(rng.choice(TOPICS[names[(i + 2) % 3]])))  # in passing
        rng.shuffle(words)
        docs.append((i, "\n".join("+" + (w.title() if k % 3 else w + "s_x") for k, w in enumerate(words))))
        truth[i] = set(own)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = spark.createDataFrame([(t, f"{t}: {' '.join(w[:3])}") for t, w in TOPICS.items()], "subject string, about string")
    l = spark.createDataFrame([(i, t) for i in range(0, n, 2) for t in truth[i]], "doc_id long, subject string")
    return d, s, l, truth


def assigned(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_held_out(spark):
    d, s, l, truth = tables(spark)
    got = assigned(subjects.subjects_of(d, s, l, rank=12))
    odd = [i for i in truth if i % 2]
    assert set(got) == set(truth)
    assert np.mean([got[i] == truth[i] for i in odd]) > 0.9


def test_without_labels_descriptions_serve(spark):
    d, s, l, truth = tables(spark)
    got = assigned(subjects.subjects_of(d, s, l.limit(0), rank=12))
    assert np.mean([bool(got[i] & truth[i]) for i in truth]) > 0.8


def test_null_empty_and_odd_texts(spark):
    d, s, l, truth = tables(spark)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n\t "), (1003, "12345 !!! 嚤凍"), (None, "goal"), (1004, "goal striker " * 30_000), (1005, "court verdict appeal clause"), (1005, "court verdict appeal clause")], "doc_id long, text string")
    labels = l.unionByName(spark.createDataFrame([(None, "law"), (1, None), (2, "unknown"), (99999, "law")], "doc_id long, subject string"))
    got = assigned(subjects.subjects_of(d.unionByName(extra), s.unionByName(spark.createDataFrame([(None, "x")], "subject string, about string")), labels, rank=12))
    assert not {1000, 1001, 1002, None} & set(got)
    assert got[1003] == {"software"} and got[1004] == {"sport"} and got[1005] == {"law"}


def test_terms():
    """Changes of case, plural s, accents and other scripts; ASCII texts give the same terms by the short way."""
    of = lambda t: sorted(subjects.Terms().count(t)[0].tolist())
    code = subjects._code
    text, terms = "courtRooms HTTP x_ab12cd ABc", sorted(map(code, ["court", "room", "http", "ab", "cd"]))
    assert of(text) == of(text + " é") == terms
    assert of("Café naïve") == sorted(map(code, ["cafe", "naive"]))
    assert of("дома 嚤凍売") == sorted(map(code, ["дома", "嚤凍", "凍売"]))


def test_empty(spark):
    d, s, l, _ = tables(spark, 20)
    assert subjects.subjects_of(d.limit(0), s, l).count() == 0
    assert subjects.subjects_of(d, s.limit(0), l).count() == 0


def test_right_vectors_are_singular(spark):
    d, *_ = tables(spark)
    v = subjects.count_terms(d, "doc_id", "text")
    words = subjects.vocabulary(v, 160)
    basis = subjects.right_vectors(subjects.weigh(v, words), len(words.idf), 6, passes=8, settled=0)
    part = v.toPandas()
    row, col, w = words.vectors(part.terms, part.counts)
    x = np.zeros((160, len(words.idf)))
    x[row, col] = w
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(np.linalg.norm(x @ basis, axis=0), s[:6], rtol=0.02)


@pytest.mark.parametrize("query", [p10_found])
def test_query(spark, sf_dir, query):
    df = query(spark, sf_dir)
    assert df.columns == ["doc_id", "subject"] and df.count() == df.distinct().count() > 0
