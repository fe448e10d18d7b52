import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intervallum.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary here")
_kept = {}


def encoder(bits):
    if bits not in _kept:
        _kept[bits] = encode.Encoder(bits=bits)
    return _kept[bits]


def knowing(texts, bits):
    """An encoder whose dictionary has every chunk of the texts, however short."""
    e = encoder(bits)
    whole, starts, _ = encode._bytes_of(pa.array(texts, pa.string()))
    low, high = encode.chunks(np.frombuffer(whole, np.uint8), starts, bits)
    e.shared = {encode.digest(whole[a:b]): e.chunk(whole[a:b]) for a, b in zip(low.tolist(), high.tolist())}
    e.reused = e.windows = 0
    return e


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    monkeypatch.setattr(encode, "LEAST_BYTES", 1)


def plain(texts):
    ranks = encoder(9).ranks
    return [ranks.encode_ordinary(t or "") for t in texts]


TEXTS = ["", None, " ", "\n\n  \n", "a", "don't  stop\t\n  now's", "<|endoftext|> is text", "x" * 5000, " " * 3000 + "y", "é ü 嚤 🧪👩‍🔬 ​  z", "def f(x):\r\n    return  x\r\n" * 50, "1234567890" * 300, "a'sb'll c'RE", "　全角  line"]


@pytest.mark.parametrize("bits", [2, 4, 9])
def test_equals_whole_text(bits):
    e = knowing([t * 3 for t in TEXTS if t], bits)
    assert e.batch(pa.array(TEXTS, pa.string())).to_pylist() == plain(TEXTS)
    assert e.batch(pa.array(TEXTS, pa.string()).slice(3, 5)).to_pylist() == plain(TEXTS[3:8])
    assert e.batch(pa.array([], pa.string())).to_pylist() == []


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sldt19 \n\t.,-é 嚤")), min_size=40, max_size=300), min_size=1, max_size=4), st.randoms())
def test_property(texts, random):
    """Chunks of the texts, known on their own, in new surroundings."""
    e = knowing(texts, 2)
    mixed = [t[random.randrange(len(t)) :] + random.choice(texts) + t[: random.randrange(len(t))] for t in texts] + texts
    assert e.batch(pa.array(mixed, pa.string())).to_pylist() == plain(mixed)


@settings(max_examples=80, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(min_size=20, max_size=200), min_size=1, max_size=4))
def test_property_unicode(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    mixed = [a + b for a in texts for b in texts]
    assert knowing(texts, 2).batch(pa.array(mixed, pa.string())).to_pylist() == plain(mixed)


def test_chunks_are_reused_wherever_they_stand():
    rng = np.random.default_rng(0)
    shared = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000))
    e = knowing([shared], 9)
    e.encoded = 0
    e.batch(pa.array([shared, "other beginning " + shared, shared[777:] + " end"]))
    assert e.reused > 2.6 * len(shared) and e.encoded < len(shared) / 2


def test_white_space_at_a_join():
    """Line ends before a digit are two pieces in the text, but one where a part ends with them."""
    t = "1" * 32 + "aaa\n\n1a1"
    for bits in (1, 2, 3):
        e = knowing([t, "b \n\n x\t\t9  y" * 5], bits)
        mixed = [t[i:] + t + t[:k] for i in range(0, len(t), 3) for k in range(0, len(t), 2)] + ["b \n\n x\t\t9  y" * n + "\n\n" for n in range(1, 9)]
        assert e.batch(pa.array(mixed, pa.string())).to_pylist() == plain(mixed)


def test_joins_grow_until_they_agree():
    """A chunk that starts inside a long run of letters agrees only where the run ends; without any other piece it is not used."""
    e = encoder(9)
    run, rest = "q" * 150, "".join(f" word{i}" for i in range(40))
    known = e.chunk((run[70:] + rest).encode())
    text = (run + rest).encode()
    offset = np.r_[0, np.cumsum(e.length[known.ids])]
    assert e.agreement(text, 0, 70, known, offset) == 80
    assert e.text(text, [(70, len(text), known)]).tolist() == e.ranks.encode_ordinary(text.decode())
    alone = e.chunk(b"q" * 300)
    assert e.text(b"q" * 450, [(100, 400, alone)]).tolist() == e.ranks.encode_ordinary("q" * 450)


def test_corpus_dictionary(spark):
    """Chunks of different rows are found over the whole corpus, within the bounds, and ids don't depend on them."""
    rng = np.random.default_rng(1)
    line = lambda n: "".join(" " + "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    common = [line(600) for _ in range(3)]
    texts = [line(20) + common[i % 3] + line(20) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = df.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    wanted = encode.shared_chunks(rows, 7)
    assert len(wanted) > 20 and len(encode.shared_chunks(rows, 7, most=5)) == 5 and not encode.shared_chunks(rows, 7, most_mb=0)
    assert set(encode.encode_shared(rows, wanted, encode.VOCABULARY, 7)) == wanted
    for most in (0, 5, 10_000):
        got = {r.doc_id: r.ids for r in encode.encode(df, bits=7, most=most).collect()}
        assert [got[i] for i in range(12)] == plain(texts)


def test_spark(spark):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(0, "", "x", [1])], "doc_id long, text string, k string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in encode.encode(df).collect())
    assert got == sorted([*enumerate(plain(TEXTS)), (0, [])])
    assert encode.encode(df.limit(0)).count() == 0
