"""Document fingerprints from prefix polynomial hashes.

For code points c_0, c_1, ... the prefix array holds H_i = sum of c_k * B^k for k < i, modulo a number; two are used. A
span's hash (H_j - H_i) * B^-i is the same wherever the span stands, so two spans of any length are compared in constant
time, and the longest common extension of two positions is found by binary search on its length.

A fingerprint is the text's whole hash, its length and the smallest `keep` hashes of all its spans of `width` code points
(the whole text where it is shorter): equal texts have equal fingerprints, and the likeness of two fingerprints estimates
the Jaccard similarity of the texts' spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import cut
from barflow.llm.wordarrays import BASE, INVERSE, mix

#: the two moduli: a Mersenne prime, and 2^64, the machine's own, whose low bits alone would be weak on long periodic texts
PRIME = (1 << 31) - 1
BASE_P = 1_103_515_245
WIDTH = 16
KEEP = 64
_U = np.uint64
_M, _S = _U(PRIME), _U(31)
_tables: list[np.ndarray] = []


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for any 64-bit x."""
    x = (x & _M) + (x >> _S)
    x = (x & _M) + (x >> _S)
    return np.where(x >= _M, x - _M, x)


def _geometric(b: int, n: int) -> np.ndarray:
    """b^0 ... b^(n-1) modulo the prime, by doubling."""
    out = np.ones(n, _U)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = _fold(out[:m] * _U(pow(b, done, PRIME)))
        done += m
    return out


def powers(n: int) -> list[np.ndarray]:
    """[B^i and B^-i modulo the prime, B^i and B^-i modulo 2^64] for i < n at least."""
    if not _tables or len(_tables[0]) < n:
        m = max(1 << 14, 1 << (n - 1).bit_length())
        wide = []
        for b in (BASE, INVERSE):
            w = np.full(m, b, _U)
            w[0] = 1
            wide.append(np.cumprod(w, dtype=_U))
        _tables[:] = [_geometric(BASE_P, m), _geometric(pow(BASE_P, -1, PRIME), m), *wide]
    return _tables


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix arrays of one text (code points) modulo both numbers; `head` of another text may be taken over as it is."""

    def __init__(self, points: np.ndarray, head: "Prefix | None" = None, shared: int = 0):
        self.n = len(points)
        table = powers(self.n + 1)
        x = points[shared:].astype(_U) + _U(1)
        self.p, self.w = np.zeros(self.n + 1, _U), np.zeros(self.n + 1, _U)
        if shared:
            self.p[: shared + 1], self.w[: shared + 1] = head.p[: shared + 1], head.w[: shared + 1]
        # terms are below 2^31, so sums of 2^32 of them fit
        self.p[shared + 1 :] = _fold(np.cumsum(_fold(x * table[0][shared : self.n]), dtype=_U) + self.p[shared])
        self.w[shared + 1 :] = np.cumsum(x * table[2][shared : self.n], dtype=_U) + self.w[shared]

    def wide(self, start: int, length: int) -> int:
        """Hash modulo 2^64 of the span [start, start + length)."""
        return (int(self.w[start + length]) - int(self.w[start])) * int(powers(self.n + 1)[3][start]) & ((1 << 64) - 1)

    def runs(self, first: int, stop: int, length: int) -> np.ndarray:
        """`wide` of every start in [first, stop)."""
        return (self.w[first + length : stop + length] - self.w[first:stop]) * powers(self.n + 1)[3][first:stop]

    def narrow(self, start: int, length: int) -> int:
        """Hash modulo the prime of the span."""
        return (int(self.p[start + length]) - int(self.p[start])) * int(powers(self.n + 1)[1][start]) % PRIME

    def whole(self) -> str:
        return f"{self.narrow(0, self.n):08x}{self.wide(0, self.n):016x}" if self.n else "0"


def equal_spans(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    return a.wide(i, length) == b.wide(j, length) and a.narrow(i, length) == b.narrow(j, length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common run that starts at position i of the one and j of the other text."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def run_hashes(p: Prefix, width: int = WIDTH, first: int = 0) -> np.ndarray:
    """32-bit hashes of all spans of `width` code points from position `first` on; of the whole text where it is shorter."""
    if not p.n:
        return np.zeros(0, np.uint32)
    w = min(width, p.n)
    return (mix(p.runs(first, p.n - w + 1, w) + _U(w)) >> _U(32)).astype(np.uint32)


def smallest(h: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The smallest `keep` distinct hashes, ascending."""
    limit = 4 * keep
    while limit < len(h):
        d = np.unique(h[h < np.uint32(min((1 << 32) - 1, (limit << 32) // len(h)))])
        if len(d) >= keep:
            return d[:keep]
        limit *= 8
    return np.unique(h)[:keep]


def head(p: Prefix) -> str:
    return f"{p.n:x}-{p.whole()}"


def fingerprint(text: str) -> str:
    p = Prefix(code_points(text))
    return f"{head(p)}-{smallest(run_hashes(p)).astype('>u4').tobytes().hex()}"


def hashes_of(fp: str) -> set[int]:
    return set(np.frombuffer(bytes.fromhex(fp.rpartition("-")[2]), ">u4").tolist())


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """1 for equal fingerprints, else the share of common hashes among the smallest of both; empty against other texts 0."""
    if a == b:
        return 1.0
    return share(hashes_of(a), hashes_of(b), keep)


def share(x: set[int], y: set[int], keep: int = KEEP) -> float:
    if not x or not y:
        return 0.0
    union = sorted(x | y)[:keep]
    return len((x & y).intersection(union)) / len(union)


def edited(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many, or all, of the other text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


#: a fingerprint travels as its head and its packed hashes, and becomes a string at the end
_COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(), "head": pa.string(), "packed": pa.binary(), "edited_head": pa.string(), "edited_packed": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "common_prefix": pa.int64()}
_ENDS = {"part": pa.int32(), "place": pa.int32(), "end_id": pa.int64(), "end_text": pa.string()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}


def _schema(columns: dict) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in columns.items())


def _record(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), columns.values())], list(columns))


class _Document:
    """What is kept of a document until the next one comes."""

    def __init__(self, doc, text: str):
        self.doc, self.text = doc, text
        self.prefix = Prefix(code_points(text))
        self.hashes = run_hashes(self.prefix)
        self.head, self.least = head(self.prefix), smallest(self.hashes)

    def row(self, following: str, other: "_Document") -> tuple:
        e = edited(self.text, following)
        kept = self.prefix.n - self.prefix.n // 3
        q = Prefix(code_points(e), self.prefix, kept)
        if q.n >= WIDTH and kept >= WIDTH:
            # spans inside the kept part have their hashes already
            same = kept - WIDTH + 1
            hashes = np.concatenate([self.hashes[:same], run_hashes(q, first=same)])
        else:
            hashes = run_hashes(q)
        own, least = head(q), smallest(hashes)
        digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest()
        near = [1.0 if self.head == h and np.array_equal(self.least, x) else share(set(self.least.tolist()), set(x.tolist())) for h, x in ((own, least), (other.head, other.least))]
        packed = [x.astype(">u4").tobytes() for x in (self.least, least)]
        return self.doc, self.prefix.n, digest, self.head, packed[0], own, packed[1], *near, common_extension(self.prefix, 0, q, 0)


def compare_in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every document against its edited text and the next document in descending doc_id.

    After the last document comes the first. Rows of one doc_id follow each other by a hash of their text; null ids come
    last. Null texts are empty; an empty table gives an empty result; a lone document is its own next. Other columns are
    left out. `common_prefix` is the longest common extension of text and edited text from their starts.

    One range partitioning puts neighbours into one task; the partition bounds hold the hash too, so rows of one id are
    spread as well. A task keeps two texts at a time. What it cannot finish, its last row, goes to a table of two rows per
    partition and is finished in a second small step.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, out, first = None, [], None
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                now = _Document(doc, text.as_py())
                if held is None:
                    first = now
                else:
                    out.append((*held.row(now.text, now), None, None, None, None))
                held = now
                if len(out) >= 500:
                    yield _record(out, _COLUMNS | _ENDS)
                    out = []
        if held is not None:
            # the partition's ends: its first and its last row
            out.append((None,) * len(_COLUMNS) + (part, 1, first.doc, first.text))
            out.append((None,) * len(_COLUMNS) + (part, 2, held.doc, held.text))
            yield _record(out, _COLUMNS | _ENDS)

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the written table fixes which rows were in which partition
    table = cut(dealt.select("doc_id", "text").mapInArrow(run, _schema(_COLUMNS | _ENDS)))
    ends = table.filter("part is not null")
    # two rows for each partition with rows, its first and its last document
    first_rows, last_rows = ends.filter("place = 1").select("part", F.col("end_text").alias("next_text")), ends.filter("place = 2").select("part", "end_id", "end_text")
    chain = ends.select("part").distinct()
    ring = chain.withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))  # one row per partition
    open_rows = last_rows.join(ring, "part").join(first_rows.withColumnRenamed("part", "next_part"), "next_part").select("end_id", "end_text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for doc, text, following in zip(*(c.to_pylist() for c in b.columns)):
                done.append(_Document(doc, text).row(following, _Document(None, following)))
            if done:
                yield _record(done, _COLUMNS)

    both = table.filter("part is null").select(*_COLUMNS).unionByName(open_rows.mapInArrow(finish, _schema(_COLUMNS)))

    def text_of(h: str, p: str, name: str):
        return F.concat(h, F.lit("-"), F.lower(F.hex(p))).alias(name)

    return both.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), text_of("head", "packed", "fingerprint"), text_of("edited_head", "edited_packed", "edited_fingerprint"), "near_edited", "near_next", "common_prefix")
