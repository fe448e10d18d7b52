"""Problem 8: token ids of whole texts by a public byte-level BPE, reusing chunks that documents share.

1. A rolling (gear) hash cuts each text where its value has zero low bits, so equal passages give equal chunks wherever they
   stand. Chunks are counted over the whole corpus by their digest; only digests and sizes are shuffled.
2. Chunks that occur at least twice, the most saving ones first, up to `SHARED` chunks and `SHARED_MB` of text (a bound of
   memory), are encoded once each. This dictionary is broadcast. All other text is encoded where it stands, so the bound
   never changes a result, only what is saved.
3. A chunk encoded on its own can differ from the whole text near its ends. Each join is repaired by re-encoding a window that
   begins in front of it and grows piece by piece into the chunk until both agree: the pre-tokenizer, run over the window,
   begins a piece where it does in the chunk alone, behind a printable ASCII character (white space at the end of a part could
   be split otherwise when more follows), and the ids of the next piece are the same. From such a place on the
   pre-tokenizer sees the same text in both, so it goes on in the same way up to the last piece that doesn't come
   near the chunk's end; from there the next window starts. A chunk without agreement is encoded with its neighbourhood.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks end at one place in 2^CHUNK_BITS; shorter or longer ones than these bytes are not shared.
CHUNK_BITS, LEAST_BYTES, MOST_BYTES = 9, 96, 4096
SHARED, SHARED_MB, ROWS = 32_768, 16, 500
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: what \s stands for there.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_GEAR = np.random.default_rng(20_140_106).integers(0, 2**32, 256, dtype=np.uint32)
_WINDOW, AHEAD = 32, 8  # bytes that the hash sees, and two characters


@lru_cache(maxsize=4)
def load_ranks(path: str = VOCABULARY):
    """The tokenizer of a rank file, and the length of each token; texts that look like special tokens are ordinary text. Loaded once a worker."""
    import tiktoken

    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    length[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions where the gear hash of the 32 bytes before ends in `bits` zeros."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        h = h.copy()
        h[k:] += h[:-k].copy() << np.uint32(k)
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def chunks(data: np.ndarray, starts: np.ndarray, bits: int = CHUNK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the chunks that may be shared. `starts`: where texts begin, and the end; chunks never cross them."""
    if not len(data):
        return np.zeros(0, int), np.zeros(0, int)
    cuts = cut_points(data, bits)
    cuts = cuts[cuts < len(data)]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # between characters
    begin = starts[np.searchsorted(starts, cuts, side="right") - 1]
    cuts = np.union1d(cuts[cuts - begin >= _WINDOW], starts)  # nothing of the text before is in the hash
    low, high = cuts[:-1], cuts[1:]
    ok = (high - low >= LEAST_BYTES) & (high - low <= MOST_BYTES)
    return low[ok], high[ok]


def digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def safe_point(part: bytes, at: int, least: int) -> int:
    """The last place in (least, at] where a printable ASCII character is followed by a blank or line end, else `least`.

    A piece always begins there, whatever stands around it.
    """
    for k in range(at, max(least, at - 200), -1):
        if k < len(part) and part[k] in (32, 10) and 32 < part[k - 1] < 127:
            return k
    return least


@dataclass
class Chunk:
    """ids of a chunk on its own, and where its pieces begin (up to the last one that its end doesn't touch)."""

    ids: np.ndarray
    begins: np.ndarray


class Encoder:
    """Encodes batches of texts with the help of a dictionary of shared chunks (digest -> Chunk)."""

    def __init__(self, path: str = VOCABULARY, bits: int = CHUNK_BITS, shared: dict[bytes, Chunk] | None = None):
        import regex

        (self.ranks, self.length), self.bits, self.shared = load_ranks(path), bits, shared or {}
        self.pieces = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.kind = np.uint16 if self.ranks.max_token_value < 2**16 else np.int32
        self.reused = self.encoded = self.windows = 0

    def plain(self, part: bytes) -> np.ndarray:
        self.encoded += len(part)
        return np.array(self.ranks.encode_ordinary(part.decode("utf-8")), self.kind)

    def begins(self, part: bytes) -> np.ndarray:
        """Where the pieces of `part` begin, whatever follows it.

        The pattern looks at most two characters past the end of a piece (contractions; a blank and what is behind it), so places
        with less than `AHEAD` bytes behind them, and the end itself, are left out.
        """
        ends = np.cumsum([len(p.encode()) for p in self.pieces.findall(part.decode("utf-8"))], dtype=np.int64)
        return np.r_[0, ends[ends + AHEAD <= len(part)]]

    def chunk(self, part: bytes) -> Chunk:
        return Chunk(self.plain(part), self.begins(part).astype(np.uint16))

    def agreement(self, text: bytes, first: int, at: int, known: Chunk, offset: np.ndarray) -> int | None:
        """Where in the chunk at `at` its own ids start to be those of the text; a piece of the text begins at `first`."""
        start = safe_point(text, at, first)
        size = 2
        while True:
            reach = known.begins[: size + 1].astype(int)
            end = at + int(reach[-1])
            window = text[start:end]
            mine = self.begins(window) - (at - start)
            both = np.intersect1d(mine, reach[:-1], assume_unique=True)
            both = [q for q in both.tolist() if at + q == first or 32 < text[at + q - 1] < 127]
            if both:
                q = int(both[0])
                after = int(reach[np.searchsorted(reach, q) + 1])
                again = self.plain(text[start : at + after])
                self.windows += 1
                own = known.ids[np.searchsorted(offset, q) : np.searchsorted(offset, after)]
                if len(again) >= len(own) and np.array_equal(again[len(again) - len(own) :], own):
                    return q
            if size >= len(known.begins):
                return None
            size *= 2

    def text(self, text: bytes, found: list[tuple[int, int, Chunk]]) -> np.ndarray:
        """ids of a text in which the chunks `found` (first, last position, chunk) are known."""
        out, first = [], 0
        for a, _, known in found:
            if len(known.begins) < 3:
                continue
            offset = np.r_[0, np.cumsum(self.length[known.ids])]
            q = self.agreement(text, first, a, known, offset)
            last = int(known.begins[-1])
            if q is None or q >= last:
                continue
            out.append(self.plain(text[first : a + q]))
            out.append(known.ids[np.searchsorted(offset, q) : np.searchsorted(offset, last)])
            self.reused += last - q
            first = a + last
        out.append(self.plain(text[first:]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """List of int32 ids per text; null and empty texts give the empty list."""
        whole, starts, bounds = _bytes_of(texts)
        found: dict[int, list[tuple[int, int, Chunk]]] = {}
        if self.shared:
            for a, b in zip(*[x.tolist() for x in chunks(np.frombuffer(whole, np.uint8), starts, self.bits)]):
                if (known := self.shared.get(digest(whole[a:b]))) is not None:
                    begin = int(starts[np.searchsorted(starts, a, side="right") - 1])
                    found.setdefault(begin, []).append((a - begin, b - begin, known))
        empty = np.zeros(0, self.kind)
        out = [self.text(whole[a:b], found.get(a, [])) if b > a else empty for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        ends = np.r_[0, np.cumsum([len(x) for x in out])]
        ids = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _bytes_of(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts end to end as UTF-8, where different ones begin and the end, and the bounds of each (nulls are empty)."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    whole = texts.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]] if texts.buffers()[2] and bounds[-1] > bounds[0] else b""
    bounds = bounds - bounds[0]
    return whole, np.unique(bounds), bounds


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def shared_chunks(rows: DataFrame, bits: int = CHUNK_BITS, most: int = SHARED, most_mb: float = SHARED_MB) -> set[bytes]:
    """Digests of the chunks of `rows` (k, t) that occur at least twice and save the most, within the bounds of count and size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            whole, starts, _ = _bytes_of(part.column(1))
            low, high = chunks(np.frombuffer(whole, np.uint8), starts, bits)
            yield pa.RecordBatch.from_arrays([pa.array([digest(whole[a:b]) for a, b in zip(low.tolist(), high.tolist())], pa.binary()), pa.array(high - low, pa.int64())], ["h", "size"])

    seen = rows.mapInArrow(count, "h binary, size long").groupBy("h", "size").agg(F.count("*").alias("n")).where("n > 1")
    top = seen.orderBy(((F.col("n") - 1) * F.col("size")).desc(), "h").limit(most).collect()  # `most` rows of 16 bytes and two numbers
    room = np.cumsum([r["size"] for r in top]) <= most_mb * 2**20
    return {bytes(r.h) for r, ok in zip(top, room) if ok}


def encode_shared(rows: DataFrame, wanted: set[bytes], path: str, bits: int = CHUNK_BITS) -> dict[bytes, Chunk]:
    """The wanted chunks of `rows` (k, t), each encoded once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted)
        for part in _parts(batches):
            whole, starts, _ = _bytes_of(part.column(1))
            out = {}
            for a, b in zip(*[x.tolist() for x in chunks(np.frombuffer(whole, np.uint8), starts, bits)]):
                h = digest(whole[a:b])
                if h in left:
                    left.discard(h)
                    out[h] = whole[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["h", "part"])

    def encode_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for part in batches:
            encoder = encoder or Encoder(path, bits)
            made = [encoder.chunk(p) for p in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.ids.astype("<i4").tobytes() for c in made], pa.binary()), pa.array([c.begins.tobytes() for c in made], pa.binary())], ["h", "ids", "begins"])

    each = rows.mapInArrow(pick, "h binary, part binary").groupBy("h").agg(F.first("part").alias("part"))
    kept = each.mapInArrow(encode_each, "h binary, ids binary, begins binary").collect()  # `SHARED_MB` of text at most
    small = np.uint16 if all(np.frombuffer(r.ids, "<i4").max(initial=0) < 2**16 for r in kept) else np.int32
    return {bytes(r.h): Chunk(np.frombuffer(r.ids, "<i4").astype(small), np.frombuffer(r.begins, np.uint16)) for r in kept}


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, bits: int = CHUNK_BITS, most: int = SHARED, most_mb: float = SHARED_MB) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens. One row per row of `documents`.

    Null and empty texts give the empty list. Rows with equal or null keys come out each. Other columns are ignored. `path`: the
    rank file, readable on every executor. `most`, `most_mb`: bounds of the dictionary of shared chunks; ids don't depend on it.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    wanted = shared_chunks(rows, bits, most, most_mb)
    shared = rows.sparkSession.sparkContext.broadcast(encode_shared(rows, wanted, path, bits) if wanted else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for part in _parts(batches):
            encoder = encoder or Encoder(path, bits, shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), encoder.batch(part.column(1))], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")
