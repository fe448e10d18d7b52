import numpy as np
import pytest

from intervallum.llm import leaks

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me", "nor", "pi") for b in ("ra", "ton", "zel", "fi") for c in ("n", "sta", "dle", "wick", "mo")]
STOCK = "Decide whether the statement follows from the passage."


def text(rng, n=60):
    return " ".join(rng.choice(WORDS, n))


def build(seed=0, items=12):
    rng = np.random.default_rng(seed)
    return rng, {i: (STOCK + "\n" if i % 2 else "") + text(rng) for i in range(1, items + 1)}


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, block int")
    e = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {tuple(r) for r in leaks.leaked(d, e).collect()}


def test_kinds_of_leaks(spark):
    rng, items = build()
    filler = lambda: text(rng, 30)
    body = lambda i: items[i].split("\n")[-1]
    words = body(2).split()
    wrapped = "\n".join("+ // " + " ".join(words[k : k + 6]) for k in range(0, 60, 6))
    changed = words.copy()
    for k in range(5, 60, 7):
        changed[k] = "changed"
    dropped = [w for k, w in enumerate(words) if k % 8]
    shuffled = list(rng.permutation(words))
    docs = [
        (1, filler() + " " + body(2) + " " + filler()), (2, wrapped), (3, " ".join(changed)), (4, " ".join(dropped)), (5, body(2).upper().replace(" ", "\\n")), (6, " ".join(words[:25])), (7, " ".join(words[:12])),
        (8, " ".join(shuffled)), (9, STOCK + " " + filler()), (10, filler()), (11, ""), (12, None), (13, " ".join(words[20:32]) + " " + filler() + " " + " ".join(words[40:55])),
        (14, " ".join(words[40:52]) + " " + filler() + " " + " ".join(words[20:32])), (15, body(1) + "\n" + body(4)), (15, filler()), (16, "".join(w + ("" if k % 9 == 3 else " ") for k, w in enumerate(words))), (17, body(3).replace("a", "á").replace(" ", " ​")),
    ]
    assert found(spark, docs, items) == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 2), (6, 2), (13, 2), (15, 1), (15, 4), (16, 2), (17, 3)}


def test_empty_and_null(spark):
    rng, items = build()
    assert found(spark, [], items) == set()
    assert found(spark, [(1, "a b c")], {}) == set()
    assert found(spark, [(1, "one"), (None, items[2])], {1: "one", 2: None, 3: "", 4: "!!"}) == set()


def test_repeated_items_and_long_text(spark):
    rng, items = build()
    same = {1: items[2], 2: items[2]}
    long_ = " ".join(rng.choice(["zz", "yy"], 200_000)) + " " + items[2] + " " + "m" * 100_000
    assert found(spark, [(1, long_)], same) == {(1, 1), (1, 2)}


def test_items_that_are_all_opening(spark):
    """The same one-sentence item in three rows, and three short items under one instruction: verbatim copies are leaks."""
    rng, _ = build()
    filler = lambda: text(rng, 30)
    whole = text(rng, 40) + "?"
    items = {1: whole, 2: whole, 3: whole, 4: STOCK + " Yes", 5: STOCK + " No", 6: STOCK + " Maybe"}
    docs = [(1, f"{filler()}. {whole} {filler()}"), (2, f"{filler()}. {STOCK} Yes {filler()}"), (3, f"{filler()}. {STOCK} {filler()}")]
    assert found(spark, docs, items) == {(1, 1), (1, 2), (1, 3), (2, 4)}


def test_long_shared_opening(spark, monkeypatch):
    """A passage with several questions is a leak of each where it is copied exactly; blocks of items change nothing."""
    rng, _ = build()
    filler = lambda: text(rng, 30)
    passage, questions = text(rng, 45) + ".", [text(rng, 15) + "?" for _ in range(4)]
    items = {i + 1: f"{passage} {q}" for i, q in enumerate(questions)} | {i + 5: f"{STOCK} {text(rng, 12)}" for i in range(4)}
    words = passage.split()
    docs = [(1, f"{filler()} {passage} {filler()}"), (2, " ".join("changed" if k % 7 == 5 else w for k, w in enumerate(words))), (3, f"{filler()} {STOCK} {filler()}")]
    expected = {(1, i) for i in range(1, 5)}
    assert found(spark, docs, items) == expected
    monkeypatch.setattr(leaks, "ITEMS", 2)
    assert found(spark, docs, items) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Every pair by comparing all words, without index or anchors."""
    rng, items = build(seed, 8)
    docs = []
    for d in range(40):
        i = int(rng.integers(1, 9))
        words = items[i].split("\n")[-1].split()
        a, n = int(rng.integers(0, 20)), int(rng.integers(5, 45))
        part = words[a : a + n]
        for k in range(3, len(part), int(rng.integers(5, 12))):
            part[k] = str(rng.choice(WORDS))
        docs.append((d, text(rng, 20) + " " + " ".join(part) + " " + text(rng, 20)))
    block = leaks.Items(list(items.items()))
    expected = set()
    for d, t in docs:
        w = leaks.words(t)
        for k, i in enumerate(block.ids):
            v = leaks.words(items[int(i)])
            points = sorted((p, q) for p in range(len(w) - 1) for q in range(len(v) - 1) if w[p] == v[q] and w[p + 1] == v[q + 1])
            total, own = leaks.coverage(leaks.chains(np.array([p for p, _ in points]), np.array([q for _, q in points])), int(block.stock[k])) if points else (0, 0)
            if total >= len(v) / 3 and own >= len(v) / 6:
                expected.add((d, int(i)))
    assert found(spark, docs, items) == expected and 5 < len(expected) < 40


def occurrences(w, v):
    """Places of equal word pairs, sorted, by plain comparison."""
    at = {}
    for q in range(len(v) - 1):
        at.setdefault((v[q], v[q + 1]), []).append(q)
    return sorted((p, q) for p in range(len(w) - 1) for q in at.get((w[p], w[p + 1]), ()))


@pytest.mark.parametrize("seed", range(4))
def test_scattered_passages_lose_nothing(seed):
    """One to four short passages with changed and dropped words, in skewed vocabularies: the search finds what a plain one finds."""
    rng = np.random.default_rng(seed)
    rank = np.arange(1, len(WORDS) + 1)
    skewed = rank ** -1.1 / (rank ** -1.1).sum()
    say = lambda n: rng.choice(WORDS, n, p=skewed).tolist()
    items = {i: " ".join(say(int(rng.choice([3, 6, 9, 14, 24, 72, 120])))) for i in range(1, 60)} | {i: STOCK + " " + " ".join(say(60)) for i in range(60, 80)}
    docs = []
    for d in range(400):
        v = items[int(rng.integers(1, 80))].split()
        doc = say(20)
        for _ in range(int(rng.integers(1, 5))):
            a, n = int(rng.integers(0, max(1, len(v) - 8))), int(rng.integers(8, 20))
            part = v[a : a + n]
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(part)))
                part[k : k + 1] = [[], ["changed"], [part[k], "added"]][int(rng.integers(0, 3))]
                part = part or ["x"]
            doc += part + say(int(rng.integers(0, 12)))
        docs.append(doc)
    block = leaks.Items(list(items.items()))
    texts = {int(i): leaks.words(items[int(i)]) for i in block.ids}
    expected = set()
    for d, w in enumerate(docs):
        for k, i in enumerate(block.ids.tolist()):
            points = occurrences(w, texts[i])
            if points and leaks.leaks_item(block, k, np.array([p for p, _ in points]), np.array([q for _, q in points])):
                expected.add((d, i))
    got = set()
    for lo in range(0, len(docs), 150):
        row = leaks.make_segment(list(range(lo, min(lo + 150, len(docs)))), docs[lo : lo + 150])
        got |= set(leaks.search_segment(block, leaks.Lexicon(block.vocabulary), leaks.open_segment(*row)))
    assert got == expected and len(expected) > 100


def test_short_items(spark):
    """An item shorter than a passage is found as a whole, and only so."""
    items = {1: "zorbo plix quandle", 2: "the mell of it"}
    docs = [(1, "so Zorbo, plix\n+ quandle it is"), (2, "zorbo plix"), (3, "the mell of all"), (4, "and the mell of it")]
    assert found(spark, docs, items) == {(1, 1), (4, 2)}


def test_one_index_for_all_items(spark, monkeypatch):
    rng, items = build()
    made = []
    monkeypatch.setattr(leaks, "ITEMS", 3)
    build_index = leaks.build_index
    monkeypatch.setattr(leaks, "build_index", lambda *a: made.append(1) or build_index(*a))
    assert found(spark, [(1, items[2]), (2, items[11])], items) == {(1, 2), (2, 11)} and len(made) == 1


def test_segment_round_trip():
    texts = [["a", "b", "a"], ["c"], ["a"] * 5]
    ids, starts, terms, counts, places = leaks.open_segment(*leaks.make_segment([7, 8, 9], texts))
    back = {}
    for t, n, e in zip(terms, counts, np.cumsum(counts)):
        for p in places[e - n : e]:
            d = int(np.searchsorted(starts, p, side="right")) - 1
            back[int(ids[d]), int(p - starts[d])] = t
    assert back == {(i, k): w for i, t in zip((7, 8, 9), texts) for k, w in enumerate(t)}


def test_words():
    assert leaks.words('+ // It\\n"Quoted" café_name2 ｆｕｌｌ &quot;x&#39; soft­hyphen') == ["it", "quoted", "cafe", "name", "2", "full", "x", "softhyphen"]
