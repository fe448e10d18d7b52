"""Problem 10: the subject areas of each document, by latent semantic analysis.

1. Each text becomes weighted terms (1 + log frequency, times inverse document frequency, unit length). No term is dropped:
   the `HEAD` commonest terms have a column each, all others share `TAIL` columns by signed hashing, so the width is the same
   at every size. Terms are known by a 32-bit hash; two that meet count as one, as in the shared columns. Document
   frequencies of all columns come from all documents; the counts are stored once in the shared folder.
2. Truncated singular value decomposition by subspace iteration over all vectors: each pass adds up small matrices per
   partition, in two stages; only the columns x RANK result reaches the driver. Passes end when the singular values settle
   (`SETTLED`), after `PASSES` at most.
3. Seed centroids: labelled documents (at most `MOST_LABELS` label rows of each subject, by hash) and the subjects'
   descriptions. They are refined over all documents that lie clearly nearest to one of them, several rounds. The `rest`
   subject has `PARTS` centroids (as many as it has labelled documents, if those are fewer), since its documents differ most.
4. A document gets every subject whose cosine similarity reaches a threshold set from the labelled documents (drawn towards
   `JOINT` with the weight of `PRIOR` of them), else its nearest subject. The `rest` subject (software: no other subject)
   stands alone, and takes what is near to nothing: cosines under `ALONE`, or under `EXPLAINED` of the text in the subspace.

Terms are runs of letters of any script, cut at changes of case, without accents and plural s; in scripts without case and
blanks, pairs of letters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from intervallum.tables import cut

RANK, PASSES, SETTLED, ROUNDS, PARTS, HEAD, TAIL, MOST_LABELS = 40, 8, 0.01, 4, 4, 8_192, 4_096, 2_000
JOINT, PRIOR, ALONE, EXPLAINED = 0.43, 20, 0.15, 0.05  # cosine for each of several subjects (start value and its weight), for the nearest one, and of text and subspace
_TERM = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_RUN = re.compile(r"[^\W\d_]+")
_BLOCK = 256


def _cut(run: str) -> list[str]:
    """The terms of a run of letters."""
    if not run.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", run) if not unicodedata.combining(c))
        if not plain.isascii():
            if plain.lower() == plain.upper():
                return [plain[i : i + 2] for i in range(max(1, len(plain) - 1))]
            return [plain.lower()]
        run = plain
    words = [w.lower() for w in _TERM.findall(run)]
    return [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in words]


def _code(term: str) -> int:
    return zlib.crc32(term.encode()) - 2**31


class Terms(dict):
    """Term as written in ASCII -> its number."""

    def __init__(self):
        super().__init__()
        self.runs: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = _code(_cut(word)[0])
        return code

    def _run(self, run: str) -> list[int]:
        """Numbers of the terms of a run of any letters."""
        if len(self.runs) > 500_000:
            self.runs.clear()
        return self.runs.setdefault(run, [_code(w) for w in _cut(run)])

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if text.isascii():  # the same terms, found without cutting runs first
            codes = np.array([self[w] for w in _TERM.findall(text)], np.int32)
        else:
            codes = np.array([c for w in _RUN.findall(text) for c in (self.runs.get(w) or self._run(w))], np.int32)
        return np.unique(codes, return_counts=True) if len(codes) else (codes, codes)


def count_terms(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(k, terms, counts) of documents whose text is not blank; binary int32 and uint32 lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for part in batches:
            for at in range(0, part.num_rows, 2000):
                few = part.slice(at, 2000)
                both = [known.count(t) for t in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array([t.astype("<i4").tobytes() for t, _ in both], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in both], pa.binary())],
                    ["k", "terms", "counts"],
                )

    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike(r"[^\s ​﻿]"))
    return rows.mapInArrow(run, "k long, terms binary, counts binary")


@dataclass
class Vocabulary:
    """Terms with a column of their own, in ascending order, and the inverse document frequency of all columns; the shared ones come last."""

    terms: np.ndarray
    idf: np.ndarray

    def columns(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and sign of each term."""
        at = np.minimum(np.searchsorted(self.terms, t), max(0, len(self.terms) - 1))
        own = self.terms[at] == t if len(self.terms) else np.zeros(len(t), bool)
        mixed = t.astype(np.uint32) * np.uint32(2_654_435_761)
        return np.where(own, at, len(self.terms) + (mixed >> np.uint32(8)) % TAIL), np.where(own | (mixed & 1 == 1), 1.0, -1.0)

    def vectors(self, terms: Iterable[bytes], counts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, weight) of the documents' unit vectors, by row."""
        size = np.array([len(x) // 4 for x in terms], np.int64)
        row = np.repeat(np.arange(len(size)), size)
        t, c = np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(counts), "<u4")
        if not len(t):
            return row[:0], row[:0], np.zeros(0, np.float32)
        col, sign = self.columns(t)
        w = (1 + np.log(c)) * self.idf[col]
        norm = np.sqrt(np.bincount(row, w * w, len(size)))
        return row, col, (sign * w / np.maximum(norm[row], 1e-12)).astype(np.float32)


def vocabulary(vectors: DataFrame, documents: int) -> Vocabulary:
    """The `HEAD` most frequent terms, and how many documents have each column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            t, n = np.unique(np.frombuffer(b"".join(part.terms), "<i4"), return_counts=True)
            yield pd.DataFrame({"term": t, "n": n.astype(np.int64)})

    seen = vectors.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.col("n").desc(), "term").limit(HEAD).toPandas().sort_values("term")
    words = Vocabulary(top.term.to_numpy(np.int32), np.zeros(0))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TAIL, np.int64)
        for part in batches:
            t = np.frombuffer(b"".join(part.terms), "<i4")
            row = np.repeat(np.arange(len(part)), [len(x) // 4 for x in part.terms])
            col = words.columns(t)[0] - len(words.terms)
            pair = np.unique(row[col >= 0] * TAIL + col[col >= 0])
            total += np.bincount(pair % TAIL, minlength=TAIL)
        yield pd.DataFrame({"c": np.arange(TAIL), "n": total})

    tail = vectors.select("terms").mapInPandas(shared, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas().sort_values("c")
    df = np.r_[top.n.to_numpy(float), tail.n.to_numpy(float) if len(tail) else np.zeros(TAIL)]
    return Vocabulary(words.terms, np.log((1 + documents) / np.maximum(df, 1)))


def weigh(vectors: DataFrame, words: Vocabulary) -> DataFrame:
    """(k, cols, weights): the unit vectors, as binary uint16 and float32 lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                part = whole.iloc[lo : lo + 2000]
                row, col, w = words.vectors(part.terms, part.counts)
                edge = np.searchsorted(row, np.arange(len(part) + 1))
                col, w = col.astype("<u2"), w.astype("<f4")
                yield pd.DataFrame({"k": part.k.to_numpy(), "cols": [col[a:b].tobytes() for a, b in zip(edge, edge[1:])], "weights": [w[a:b].tobytes() for a, b in zip(edge, edge[1:])]})

    return vectors.mapInPandas(run, "k long, cols binary, weights binary")


def sparse(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of weighed vectors, by row."""
    size = np.array([len(x) // 2 for x in part.cols], np.int64)
    return np.repeat(np.arange(len(size)), size), np.frombuffer(b"".join(part.cols), "<u2"), np.frombuffer(b"".join(part.weights), "<f4")


def _segment_sum(values: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Sum of rows of `values` by ascending `key`."""
    out = np.zeros((size, values.shape[1]))
    if len(key):
        start = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
        out[key[start]] = np.add.reduceat(values, start, axis=0)
    return out


def project(vectors: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, basis: np.ndarray) -> np.ndarray:
    """Rows of X times `basis`."""
    row, col, w = vectors
    return _segment_sum(basis.astype(np.float32)[col] * w[:, None], row, rows)


def right_vectors(weighed: DataFrame, size: int, rank: int = RANK, passes: int = PASSES, seed: int = 5, settled: float = SETTLED) -> np.ndarray:
    """The first `rank` right singular vectors of all documents (`size` columns x rank)."""
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, rank + 8))))[0]
    width = basis.shape[1]

    def run(basis: np.ndarray):
        basis = basis.astype(np.float32)

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros((size, width)), 0
            for whole in batches:
                for at in range(0, len(whole), 1000):
                    part = whole.iloc[at : at + 1000]
                    row, col, w = sparse(part)
                    down = project((row, col, w), len(part), basis).astype(np.float32)
                    order = np.argsort(col, kind="stable")  # a radix sort: two bytes
                    col = col[order]
                    start = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]) if len(col) else np.zeros(0, int)
                    if len(col):
                        total[col[start]] += np.add.reduceat(down[row[order]] * w[order][:, None], start, axis=0)
                    seen += len(part)
            if seen:
                salt = TaskContext.get().partitionId() // 64
                cuts = range(0, size, _BLOCK)
                yield pd.DataFrame({"block": list(cuts), "salt": salt, "sums": [total[i : i + _BLOCK].astype("<f4").tobytes() for i in cuts]})

        return go

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f4").astype(float) for x in part.sums)
        return pd.DataFrame({"block": [part.block.iloc[0]], "salt": [part.salt.iloc[0] // 64], "sums": [total.astype("<f4").tobytes()]})

    schema, singular, last = "block int, salt int, sums binary", None, None
    for _ in range(passes):
        parts = weighed.mapInPandas(run(basis), schema)
        sums = parts.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).toPandas()
        product = np.zeros((size, width))
        for r in sums.itertuples():
            product[r.block : r.block + _BLOCK] = np.frombuffer(r.sums, "<f4").reshape(-1, width)
        small = basis.T @ product  # Rayleigh-Ritz: rotate the basis to the singular directions
        value, turn = np.linalg.eigh((small + small.T) / 2)
        singular = turn[:, np.argsort(-value)]
        basis = np.linalg.qr(product @ singular)[0]
        value = float(np.sort(value)[::-1][:rank].sum())
        if last is not None and abs(value - last) <= settled * abs(value):
            break
        last = value
    return basis[:, : min(rank, width)]


def unit(z: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Rows of length 1; those not longer than `least` become 0."""
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return np.where(norm > least, z / np.maximum(norm, 1e-12), 0.0)


@dataclass
class Centroids:
    """Unit centroids; `of[i]` is the subject of centroid i."""

    subjects: list[str]
    rest: str | None
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))
    joint: float = JOINT

    def seed(self, z: np.ndarray, labels: list[list[str]], about: np.ndarray) -> None:
        """From labelled documents (unit rows z) of one subject, split into parts, or from the description where there are none."""
        of, out = [], []
        for k, s in enumerate(self.subjects):
            own = z[[i for i, l in enumerate(labels) if l == [s]]]
            own = own[np.linalg.norm(own, axis=1) > 0]
            parts = min(PARTS, len(own)) if s == self.rest else 1
            if not len(own):
                group = about[k : k + 1]
            elif parts == 1:
                group = own.mean(0, keepdims=True)
            else:
                group = own[:1]
                for _ in range(parts - 1):  # farthest first, then a few rounds of spherical k-means
                    group = np.vstack([group, own[(own @ group.T).max(1).argmin()]])
                for _ in range(10):
                    near = (own @ group.T).argmax(1)
                    group = unit(np.vstack([own[near == j].mean(0) if (near == j).any() else group[j] for j in range(parts)]))
            of += [k] * len(group)
            out.append(group)
        self.of, self.vectors = np.array(of), unit(np.vstack(out))

    def cosines(self, z: np.ndarray) -> np.ndarray:
        """Documents x subjects: the cosine to the nearest centroid of each subject."""
        c = z @ self.vectors.T
        out = np.full((len(z), len(self.subjects)), -1.0)
        for i, k in enumerate(self.of):
            out[:, k] = np.maximum(out[:, k], c[:, i])
        return out

    def clear(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which documents lie clearly nearest to one centroid, and to which."""
        c = z @ self.vectors.T
        by = np.sort(self.cosines(z), 1)
        margin = by[:, -1] - by[:, -2] if by.shape[1] > 1 else by[:, -1]
        return (by[:, -1] > 0.6) & (margin > 0.2), c.argmax(1)

    def assign(self, z: np.ndarray) -> np.ndarray:
        """Documents x subjects, true where the subject belongs to the document."""
        c = self.cosines(z)
        rest = self.subjects.index(self.rest) if self.rest in self.subjects else -1
        others = c.copy()
        if rest >= 0:
            others[:, rest] = -1
        top = others.argmax(1)
        best = others[np.arange(len(c)), top]
        out = others >= self.joint
        out[np.arange(len(c)), top] = True
        if rest >= 0:
            alone = (c[:, rest] >= best) | (best < ALONE)
            out[alone] = False
            out[alone, rest] = True
        return out

    def set_joint(self, z: np.ndarray, labels: list[list[str]]) -> None:
        """The threshold between second subjects and passing words: the fewest errors on labelled documents with and without
        them, plus those of `PRIOR` made-up documents whose second subjects and passing words meet at `JOINT`."""
        c = self.cosines(z)
        index = {s: k for k, s in enumerate(self.subjects)}
        second, passing = [], []
        for i, own in enumerate(labels):
            ks = [index[s] for s in own if s in index]
            if self.rest in own or not ks:
                continue
            other = [c[i, k] for k, s in enumerate(self.subjects) if k not in ks and s != self.rest]
            if other:
                passing.append(max(other))
            if len(ks) > 1:
                second.append(c[i, ks].min())
        steps = np.arange(0.3, 0.56, 0.005)
        wrong = np.array([(np.array(second) < s).sum() + (np.array(passing) >= s).sum() for s in steps]) + PRIOR * np.abs(steps - JOINT)
        self.joint = float(np.mean(steps[wrong <= wrong.min() + 1e-9]))


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rest: str | None = "software", rank: int = RANK) -> DataFrame:
    """(key, subject): one row per document and subject. Null, empty and blank texts have none; every other document has at least one.

    subjects: (subject, about), labels: (key, subject); labels of unknown documents or subjects, and nulls, are ignored.
    Equal texts get equal subjects; documents with equal keys are judged each, and equal rows come out once.
    """
    spark = documents.sparkSession
    info = {r.subject: r.about or "" for r in subjects.select("subject", "about").dropna(subset=["subject"]).collect()}
    names = sorted(info)
    vectors = cut(count_terms(documents, key, text))
    n = vectors.count()
    empty = spark.createDataFrame([], f"{key} long, subject string")
    if not n or not names:
        return empty
    words = vocabulary(vectors, n)
    weighed = cut(weigh(vectors, words))
    basis = right_vectors(weighed, len(words.idf), rank)
    width = basis.shape[1]

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                part = whole.iloc[at : at + 1000]
                z = unit(project(sparse(part), len(part), basis), EXPLAINED).astype("<f4")
                yield pd.DataFrame({"k": part.k.to_numpy(), "z": [x.tobytes() for x in z]})

    placed = cut(weighed.mapInPandas(embed, "k long, z binary"))
    unpack = lambda z: np.frombuffer(b"".join(z), "<f4").reshape(-1, width).astype(float)
    known = labels.select(F.col(key).cast("long").alias("k"), "subject").dropna().where(F.col("subject").isin(names)).distinct()
    known = known.withColumn("_n", F.row_number().over(W.partitionBy("subject").orderBy(F.xxhash64("k"), "k"))).where(F.col("_n") <= MOST_LABELS)
    known = labels.select(F.col(key).cast("long").alias("k"), "subject").dropna().where(F.col("subject").isin(names)).join(F.broadcast(known.select("k").distinct()), "k", "left_semi")  # all subjects of the chosen documents
    marked = placed.join(known.groupBy("k").agg(F.sort_array(F.collect_set("subject")).alias("own")), "k").toPandas()
    z, own = unpack(marked.z), [list(x) for x in marked.own]
    tokens = Terms()
    counted = [tokens.count(f"{s} {info[s]}") for s in names]
    about = words.vectors([t.astype("<i4").tobytes() for t, _ in counted], [c.astype("<u4").tobytes() for _, c in counted])
    about = unit(project(about, len(names), basis))
    model = Centroids(names, rest if rest in names else None)
    model.seed(z, own, about)

    def refine(model: Centroids):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(model.vectors.shape), np.zeros(len(model.of))
            for part in batches:
                rows = unpack(part.z)
                if not len(rows):
                    continue
                sure, near = model.clear(rows)
                for j in range(len(model.of)):
                    total[j] += rows[sure & (near == j)].sum(0)
                    n[j] += (sure & (near == j)).sum()
            yield pd.DataFrame({"c": np.repeat(np.arange(len(n)), width), "d": np.tile(np.arange(width), len(n)), "v": total.ravel(), "n": np.repeat(n, width)})

        return go

    for _ in range(ROUNDS):
        sums = placed.mapInPandas(refine(model), "c int, d int, v double, n double").groupBy("c", "d").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("c", "d").toPandas()
        total, count = sums.v.to_numpy().reshape(-1, width), sums.n.to_numpy().reshape(-1, width)[:, :1]
        model.vectors = np.where(count >= 3, unit(total), model.vectors)
    model.set_joint(z, own)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = unpack(part.z)
            if len(rows):
                at, which = np.nonzero(model.assign(rows))
                yield pd.DataFrame({key: part.k.to_numpy()[at], "subject": np.array(names, object)[which]})

    return placed.mapInPandas(assign, f"{key} long, subject string")
