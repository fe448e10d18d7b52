"""Problem 9: evaluation texts inside training texts, by a distributed positional inverted index.

The index holds the whole corpus, whatever the items: it is cut by documents into segments, and each segment has its words
and the posting list (positions of all its documents) of each. It is built once, where the documents are read, and stored in
the shared folder; any number of evaluation items is searched in it, in blocks of `ITEMS` that only bound memory.

Terms of the search are pairs of adjacent words of an item; their postings come from the lists of both words, offset by one. In
each segment an item's rarest terms lead: a passage of w words that counts has at least 4/9 w intact terms at different places
of the item, and passages that overlap in the item share at most half of theirs, so a leak of n/3 words has at least 2n/27
terms at different places (`Items.least`). Leaving out the commonest half of so many, every leak still hits the other half
of them, wherever its passages stand: so no leak is lost, and common terms are looked up only for documents that are candidates
by rare ones. There all postings of the item are chained, in order and close together, into exact phrases and near matches
(single changed, added or dropped words). A document leaks an item if its passages, in the item's order, span at least
`SHARE` of the item's words; opening instructions that several items share count only beside a passage of the item itself.
Items share an opening if `STOCK_ITEMS` different texts of the whole table begin with it. One of more than `STOCK_WORDS` words
is no instruction (a passage with several questions, say): an unbroken run of more words than that within it counts as well.

A passage that counts has at least `LEAST_WORDS` words (or the whole item, if that is shorter), at least `LEAST_TERMS` intact
terms, on half of its places, and no stretch of more than `GAP` places without one. Text so interleaved with other words that
no stretch meets this is no passage. Segments are cut by documents, so no hot term is ever gathered in one task.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervallum.tables import cut

SHARE, GAP, LEAST_TERMS, LEAST_WORDS, ITEMS, STOCK_ITEMS, STOCK_WORDS = 1 / 3, 3, 4, 8, 20_000, 3, 20
#: Bounds of memory, not of results: documents and words of a segment, places between its documents, occurrences expanded at once.
SEGMENT_DOCS, SEGMENT_WORDS, APART, EXPANDED = 2_000, 1_000_000, 8, 1_000_000
_WORD = re.compile(r"[^\W\d_]+|\d+")
_ESCAPE = re.compile(r"\\(?:[nrtbfv]|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2})|&(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]{1,6});|\\|[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Lower-case words and numbers, without marks, escapes, accents and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", re.sub(r"[­​-‏⁠﻿]", "", text)) if not unicodedata.combining(c))
    if "\\" in text or "&" in text:
        text = _ESCAPE.sub(" ", text)
    return _WORD.findall(text.lower())


class Lexicon(dict):
    """Word -> id of an item word, -1 for other words, under -1 for words that are item words run together."""

    def __init__(self, vocabulary: list[str], most: int = 500_000):
        super().__init__({w: i for i, w in enumerate(vocabulary)})
        self.base, self.most = dict(self), most
        self.joined: list[list[int]] = []
        self.longest = max((len(w) for w in vocabulary), default=0)

    def __missing__(self, word: str) -> int:
        parts = self._split(word) if 6 <= len(word) <= 80 else None
        code = -1
        if parts:
            self.joined.append(parts)
            code = -1 - len(self.joined)
        self[word] = code
        return code

    def trim(self) -> None:
        """Forgets other words when there are many; codes given before are void."""
        if len(self) > self.most + len(self.base):
            self.clear()
            self.update(self.base)
            self.joined.clear()

    def _split(self, word: str) -> list[int] | None:
        """The fewest item words of three or more letters that make up the whole word."""
        best: list[list[int] | None] = [[]] + [None] * len(word)
        for start in range(len(word) - 2):
            if best[start] is None:
                continue
            for end in range(start + 3, min(len(word), start + self.longest) + 1):
                w = self.base.get(word[start:end])
                if w is not None and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                    best[end] = [*best[start], w]
        return best[len(word)]


class Items:
    """One block of evaluation items: words, terms (word pairs), where each term stands, and the length of opening stock words.

    `shared`: the openings that several items of the whole table share; counted in the block if not given.
    """

    def __init__(self, rows: list[tuple[int, str]], shared: set[str] | None = None, share: float = SHARE):
        self.share = share
        texts = [(i, words(t)) for i, t in rows]
        if shared is None:
            opening = Counter(o for o, _ in {(self._opening(t), tuple(words(t))) for _, t in rows})
            shared = {o for o, n in opening.items() if n >= STOCK_ITEMS}
        stock = [len(words(self._opening(t))) if self._opening(t) in shared else 0 for _, t in rows]
        stock = [n for n, (_, w) in zip(stock, texts) if len(w) > 1]
        texts = [(i, w) for i, w in texts if len(w) > 1]
        self.vocabulary = sorted({w for _, ws in texts for w in ws})
        at = {w: k for k, w in enumerate(self.vocabulary)}
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.length = np.array([len(w) for _, w in texts], np.int64)
        self.stock = np.array([n if n < len(w) else 0 for n, (_, w) in zip(stock, texts)], np.int64)  # an item that is all opening has none
        term, item, where = [], [], []
        for k, (_, ws) in enumerate(texts):
            v = np.array([at[w] for w in ws], np.int64)
            term.append(v[:-1] * len(self.vocabulary) + v[1:])
            item.append(np.full(len(v) - 1, k))
            where.append(np.arange(len(v) - 1))
        code = np.concatenate(term) if term else np.zeros(0, np.int64)
        self.terms, t = np.unique(code, return_inverse=True)
        order = np.argsort(t, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.where = np.concatenate(where)[order] if where else np.zeros(0, np.int64)
        self.start = np.r_[0, np.cumsum(np.bincount(t, minlength=len(self.terms)))]

    @staticmethod
    def _opening(text: str | None) -> str:
        """The first line or sentence, by which items may share an instruction."""
        return re.split(r"(?<=[.?!:])\s|\n", (text or "").strip(), maxsplit=1)[0].lower()

    @property
    def least(self) -> np.ndarray:
        """Of each item: the number of different places at which a leak has intact terms, at least."""
        return np.maximum(np.ceil(2 * self.share * self.length / 9 - 1e-9).astype(int), self.least_terms)

    @property
    def least_terms(self) -> np.ndarray:
        return np.minimum(LEAST_TERMS, self.length - 1)

    @property
    def least_own(self) -> np.ndarray:
        """The same outside short stock words: a passage has a term in every `GAP` places, and ends with one."""
        own = np.minimum(self.share * self.length / 2, self.length - self.stock)
        return np.where((self.stock > 0) & (self.stock <= STOCK_WORDS), np.maximum((own / (2 * GAP + 1)).astype(int), 1), 0)

    def anchors(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a term in an item: is it one of the rarest? And of each item: how many of those a leak has at least."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.start))
        out = np.zeros(len(term), bool)
        order = np.lexsort((self.where, frequency[term], self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        hits = (self.least + 1) // 2
        out[order] = rank < (self.length - 1 - self.least + hits)[item]
        return out, hits


class _Numbers(dict):
    """Word -> its number, in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


SEGMENT = "ids binary, starts binary, terms binary, counts binary, places binary"


def make_segment(ids: list[int], texts: list[list[str]]) -> list[bytes]:
    """A row of `SEGMENT`: the documents laid end to end, and the postings of every word."""
    numbers = _Numbers()
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size + APART) - size - APART
    code = np.array([numbers[w] for t in texts for w in t], np.int32)
    place = np.arange(len(code)) + np.repeat(np.arange(len(texts)) * APART, size)
    order = np.argsort(code, kind="stable")
    place = place[order]
    step = np.diff(place, prepend=0)
    counts = np.bincount(code, minlength=len(numbers)) if len(code) else np.zeros(0, int)
    first = np.cumsum(counts) - counts
    step[first] = place[first]
    pack = lambda x: zlib.compress(x, 1)
    return [np.array(ids, "<i8").tobytes(), starts.astype("<i8").tobytes(), pack("\n".join(numbers).encode()), pack(counts.astype("<i4").tobytes()), pack(step.astype("<i4").tobytes())]


def open_segment(ids: bytes, starts: bytes, terms: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """ids and starts of the documents, words, length of their posting lists, and the lists end to end."""
    n = np.frombuffer(zlib.decompress(counts), "<i4").astype(np.int64)
    run = np.cumsum(np.frombuffer(zlib.decompress(places), "<i4"), dtype=np.int64)
    first = np.cumsum(n) - n
    before = np.where(first > 0, run[first - 1], 0) if len(n) else first
    text = zlib.decompress(terms).decode()
    return np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8"), text.split("\n") if text else [], n, run - np.repeat(before, n)


def build_index(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The segments of all documents with a key and words, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        make = lambda ids, texts: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in make_segment(ids, texts)], names)
        ids, texts, total = [], [], 0
        for part in batches:
            for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                found = words(t.as_py())
                if not found:
                    continue
                ids.append(i)
                texts.append(found)
                total += len(found)
                if len(ids) >= SEGMENT_DOCS or total >= SEGMENT_WORDS:
                    yield make(ids, texts)
                    ids, texts, total = [], [], 0
        if ids:
            yield make(ids, texts)

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    return cut(rows.mapInArrow(run, SEGMENT))


def chains(doc_at: np.ndarray, item_at: np.ndarray, length: int = 1_000) -> list[tuple[int, int, int, int]]:
    """Passages of an item of `length` words as (first place in the document, first and last place in the item, matched terms)."""
    terms, size = min(LEAST_TERMS, length - 1), min(LEAST_WORDS, length)
    active: list[list[int]] = []
    done: list[list[int]] = []
    for p, q in zip(doc_at.tolist(), item_at.tolist()):
        best = None
        still = []
        for c in active:
            if p - c[0] > GAP:
                done.append(c)
                continue
            still.append(c)
            if 0 < p - c[0] and 0 < q - c[1] <= GAP and abs((p - c[0]) - (q - c[1])) <= 1 and (best is None or c[4] > best[4]):
                best = c
        active = still
        if best is None:
            active.append([p, q, p, q, 1])
        else:
            best[0], best[1], best[4] = p, q, best[4] + 1
    return [(c[2], c[3], c[1], c[4]) for c in done + active if c[4] >= terms and c[1] - c[3] + 2 >= size and 2 * c[4] >= c[1] - c[3] + 1]


def coverage(passages: list[tuple[int, int, int, int]], stock: int) -> tuple[int, int]:
    """Words of the item in passages that follow each other in its order: all, and those after the stock words."""
    passages = sorted(passages)
    best: list[tuple[int, int, int]] = []
    for p, a, b, _ in passages:
        got, own, end = b - a + 2, max(0, b + 2 - max(a, stock)), b + 1
        for total, beside, last in best[:]:
            if last < b + 1:
                new = max(0, b + 1 - max(a - 1, last))
                cand = (total + new, beside + max(0, b + 2 - max(a, stock, last + 1)), end)
                if cand > (got, own, end):
                    got, own = cand[0], cand[1]
        best.append((got, own, end))
    return max(((t, o) for t, o, _ in best), default=(0, 0))


def exact_run(doc_at: np.ndarray, item_at: np.ndarray, stock: int) -> int:
    """Words of the longest unbroken run within a shared opening of `stock` words; 0 unless there are more than `STOCK_WORDS`."""
    inside = item_at + 2 <= stock
    if stock <= STOCK_WORDS or not inside.any():
        return 0
    offset, q = np.unique(np.column_stack([doc_at[inside] - item_at[inside], item_at[inside]]), axis=0).T
    new = np.r_[True, (np.diff(offset) != 0) | (np.diff(q) != 1)]
    longest = int(np.bincount(np.cumsum(new) - 1).max()) + 1
    return longest if longest > STOCK_WORDS else 0


def _postings(items: Items, lexicon: Lexicon, terms: list[str], counts: np.ndarray, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, term of the items) of every word pair of the segment that is a term, in order of place."""
    codes = np.array([lexicon[t] for t in terms], np.int64)
    known = codes != -1
    mine = np.repeat(known, counts)
    place, code = places[mine], np.repeat(codes[known], counts[known])
    order = np.argsort(place, kind="stable")
    place, code = place[order], code[order]
    doc = np.searchsorted(starts, place, side="right") - 1
    joined = code < -1
    if joined.any():  # words run together take as many places as they have parts
        parts = [lexicon.joined[-2 - c] for c in code[joined].tolist()]
        size = np.ones(len(code), np.int64)
        size[joined] = [len(p) for p in parts]
        row = np.repeat(np.arange(len(code)), size)
        place = place[row] + np.arange(len(row)) - row
        is_joined = joined[row]
        code, doc = code[row], doc[row]
        code[is_joined] = np.concatenate([np.array(p, np.int64) for p in parts])
    near = np.flatnonzero(place[1:] - place[:-1] == 1) if len(place) > 1 else np.zeros(0, np.int64)
    pair = code[near] * len(items.vocabulary) + code[near + 1] if len(near) else near
    term = np.minimum(np.searchsorted(items.terms, pair), len(items.terms) - 1)
    hit = items.terms[term] == pair
    return doc[near][hit], place[near][hit], term[hit]


def _linked(pair: np.ndarray, pos: np.ndarray, where: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Occurrences of pairs that have `least` occurrences in a row that a chain could follow; sorted by pair, place, where."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shift = 1
    while shift < len(pair):
        step = pos[shift:] - pos[:-shift]
        near = (pair[shift:] == pair[:-shift]) & (step <= GAP)
        if not near.any():
            break
        on = where[shift:] - where[:-shift]
        at = np.flatnonzero(near & (step > 0) & (on > 0) & (on <= GAP) & (np.abs(step - on) <= 1))
        left.append(at)
        right.append(at + shift)
        shift += 1
    i, j = np.concatenate(left), np.concatenate(right)
    long_ = [np.ones(len(pair), bool)]
    for _ in range(LEAST_TERMS - 1):
        after = np.zeros(len(pair), bool)
        after[j[long_[-1][i]]] = True
        long_.append(after)
    enough = np.choose(np.clip(least, 1, LEAST_TERMS) - 1, long_) if len(pair) else np.zeros(0, bool)
    return np.isin(pair, np.unique(pair[enough]))


def search_segment(items: Items, lexicon: Lexicon, segment: tuple) -> list[tuple[int, int]]:
    """(document id, item id) of the leaks in one segment."""
    ids, starts, terms, counts, places = segment
    lexicon.trim()
    doc, pos, term = _postings(items, lexicon, terms, counts, places, starts)
    if not len(doc):
        return []
    anchor, hits = items.anchors(np.bincount(term, minlength=len(items.terms)))
    size = np.diff(items.start)[term]
    n, most = len(items.ids), int(items.length.max())

    def expand(rows: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, place in the item) of every occurrence of the rows' terms in items."""
        row = np.repeat(rows, size[rows])
        at = np.repeat(items.start[term[rows]], size[rows]) + np.arange(len(row)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
        if only is not None:
            keep = only[at]
            row, at = row[keep], at[keep]
        return row, items.item[at], items.where[at]

    def places_of(pair: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, and at how many different places of the item each has a term."""
        return np.unique(np.unique(pair * most + where) // most, return_counts=True)

    def among(pair: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return chosen[np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)] == pair if len(chosen) else np.zeros(len(pair), bool)

    out: list[tuple[int, int]] = []
    edge = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]  # documents
    total = np.r_[0, np.cumsum(size)][edge]
    lo = 0
    while lo < len(edge) - 1:  # whole documents, EXPANDED occurrences at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + EXPANDED, side="right")) - 1)
        rows = np.arange(edge[lo], edge[hi])
        lo = hi
        row, item, where = expand(rows, anchor)
        pair, found = places_of(doc[row] * n + item, where)
        chosen = pair[found >= hits[pair % n]]
        if not len(chosen):
            continue
        row, item, where = expand(rows[np.isin(doc[rows], chosen // n)], None)
        pair = doc[row] * n + item
        keep = among(pair, chosen)
        row, where, pair = row[keep], where[keep], pair[keep]
        all_, found = places_of(pair, where)
        chosen = all_[found >= items.least[all_ % n]]
        own = where + 1 >= items.stock[pair % n]
        outside = np.zeros(len(chosen), np.int64)
        with_own, found = places_of(pair[own], where[own])
        there = among(with_own, chosen)
        outside[np.searchsorted(chosen, with_own[there])] = found[there]
        chosen = chosen[outside >= items.least_own[chosen % n]]
        keep = among(pair, chosen)
        row, where, pair = row[keep], where[keep], pair[keep]
        order = np.lexsort((where, pos[row], pair))
        row, where, pair = row[order], where[order], pair[order]
        keep = _linked(pair, pos[row], where, items.least_terms[pair % n])
        row, where, pair = row[keep], where[keep], pair[keep]
        bounds = np.r_[0, np.flatnonzero(np.diff(pair)) + 1, len(pair)] if len(pair) else np.zeros(1, int)
        for a, b in zip(bounds, bounds[1:]):
            k = int(pair[a] % n)
            if leaks_item(items, k, pos[row[a:b]], where[a:b]):
                out.append((int(ids[pair[a] // n]), int(items.ids[k])))
    return out


def leaks_item(items: Items, k: int, doc_at: np.ndarray, item_at: np.ndarray) -> bool:
    """The rule: do the occurrences of the terms of item `k` in one document, sorted by both places, make up a leak?"""
    length, stock = int(items.length[k]), int(items.stock[k])
    need = items.share * length
    total, own = coverage(chains(doc_at, item_at, length), stock)
    own += exact_run(doc_at, item_at, stock)
    return total >= need and own >= min(need / 2, length - stock)


def search_index(index: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id) of the leaks in a stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(items.vocabulary)
        for part in batches:
            found = [x for row in zip(*[c.to_pylist() for c in part.columns]) for x in search_segment(items, lexicon, open_segment(*row))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

    return index.mapInArrow(run, "doc_id long, item_id long")


def shared_openings(rows: DataFrame) -> set[str]:
    """Openings of at least `STOCK_ITEMS` different texts (text; equal words make equal texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"opening": [Items._opening(t) for t in part.text], "body": [hashlib.md5(" ".join(words(t)).encode("utf-8", "replace")).hexdigest() for t in part.text]})

    seen = rows.select("text").mapInPandas(run, "opening string, body string").where("opening <> ''").groupBy("opening").agg(F.countDistinct("body").alias("n"))
    return {r.opening for r in seen.where(F.col("n") >= STOCK_ITEMS).select("opening").collect()}  # a third of the items at most


def leaked(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id): one row per document and leaked item; see the module for the rule.

    Null and empty texts leak nothing and are leaked by nothing; items of one word can't be found, items of 2 to 7 words only
    as a whole. Rows of documents with equal ids are judged each, and a pair comes out once. Other columns of both tables are
    ignored. The index of the documents is built once, however many items there are.
    """
    rows = eval_items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().orderBy("item_id")
    shared = shared_openings(rows)
    parts: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    index = None

    def close() -> None:
        nonlocal index
        items = Items(block, shared, share)
        if len(items.terms):
            index = build_index(documents, key, text) if index is None else index
            parts.append(search_index(index, items))

    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS:
            close()
            block = []
    if block:
        close()
    if not parts:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
