"""Documents linked by the Jaccard similarity of their word shingles: an exact join with PartEnum signatures.

A document's set holds the hashes of its distinct runs of five words. Sets of sizes a and b with similarity 3/4 or more
differ in at most (a + b) / 7 elements. The domain of hashes is partitioned, more finely for larger sizes; a set's signature
in a part is the hash of all its elements there. Of the parts that either set fills, at most (a + b) / 7 can differ, so two
sets share a signature if both enumerate their first k + 1 filled parts, in one order for all, with k the difference to the
largest partner. Sizes are banded, and a set signs in each band where it may meet a partner. Elements that many documents
have (counted over all documents) are partitioned apart and come last in the order, so passages that many documents share
seldom sign.

From signatures to classes:

1. Equal sets are linked by their hash alone.
2. Within a signature every document is paired with the smallest only, its centre. Pairs pass an exact lower bound of the
   difference (parity bits of the elements) and are then verified on whole texts. Components of the verified links follow.
3. Two linked documents share a signature, hence a centre. So a component and all documents that have one of its documents
   as a centre form a family, and each document outside the component is held against the whole family, by the bound and in
   blocks of bounded size; the few pairs that pass are verified like the others.

No step emits the pairs of a group, and no link is lost: the result equals the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import ascii_lower, cut
from barflow.llm.components import components
from barflow.llm.wordarrays import NOT_SPACE, Words, distinct, mix, pieces, shingles

WIDTH = 5
_U = np.uint64
#: sizes of a band, its growth, elements a part holds at the band's upper end
GROWTH, LOAD, SINGLE = 4, 2.2, 64
#: elements that come last in the order: the most frequent ones, this many at most, of which a task saw two or more
FREQUENT = 1_000_000
#: documents of a block in which a family is compared
BLOCK = 2000


def differences(n: np.ndarray) -> np.ndarray:
    """The largest difference to a partner: (n + m) / 7 for the largest m with 3 m <= 4 n."""
    return (n + 4 * n // 3) // 7


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(GROWTH ** np.arange(1, 32, dtype=np.int64), n, "right")


def parts_of(b: int, level: int) -> int:
    """Parts of the domain in a band; 0: every element is a part of its own."""
    top = GROWTH ** (b + 1)
    return 0 if top <= SINGLE or level > 6 else int(top / LOAD) << level


def _place(v: np.ndarray, parts: int, seed: int) -> np.ndarray:
    x = mix(v + _U(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
    return x % _U(parts) if parts else x >> _U(1)


def sets_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(col, NOT_SPACE)
    h, rows = shingles(w, WIDTH)
    return distinct(h, rows, w.rows)


def sketch(v: np.ndarray) -> bytes:
    """Parity of the number of elements in each of 4 n to 8 n parts, as bits. Bits in which two sketches differ never
    outnumber the elements in which the sets differ."""
    m = 1 << (len(v).bit_length() + 2)
    odd = np.bincount((v >> _U(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) with as few parts as `size` bytes hold: parts are low bits, so halves are added."""
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def least_difference(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(t, np.uint8)[None, :] for t in (a, b))
    size = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


# --- first pass: sizes, set hashes, sketches, frequent elements -------------------------------------------------------

_FIRST = "doc_id long, n long, h1 long, h2 long, counts binary, own int, next int, element long, documents long"
_FIRST_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_FIRST_NAMES = [f.split()[0] for f in _FIRST.split(", ")]


def _level(v: np.ndarray, b: int, k: int, seed: int = 0) -> int:
    """The coarsest partition in which the set fills more than k parts."""
    level = 0
    while (p := parts_of(b, level)) and len(np.unique(_place(v, p, seed))) <= k:
        level += 1
    return level


def _bands(n: int) -> list[int]:
    b = int(band(np.int64(n)))
    return [b, b + 1] if 4 * n // 3 >= GROWTH ** (b + 1) else [b]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def common() -> pa.RecordBatch | None:
        v, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, _U), np.zeros(0, int))
        often = n >= 2
        if not often.any():
            return None
        v, n = v[often], n[often]
        none = [pa.nulls(len(v), t) for t in _FIRST_TYPES[:7]]
        return pa.RecordBatch.from_arrays([*none, pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], _FIRST_NAMES)

    for b in pieces(batches, "text"):
        v, first = sets_of(b.column(1))
        one, two = mix(v), mix(v ^ _U(0xD6E8FEB86659FD93))
        rows = []
        for i, doc in enumerate(b.column(0).to_pylist()):
            s = v[first[i] : first[i + 1]]
            n = len(s)
            if n:
                at, k = _bands(n), int(differences(np.int64(n)))
                levels = [_level(s, x, k) for x in at]
                h = [int(x[first[i] : first[i + 1]].sum(dtype=_U).astype(np.int64)) for x in (one, two)]
                rows.append((doc, n, *h, sketch(s), levels[0], levels[1] if len(at) > 1 else None, None, None))
            else:
                rows.append((doc, 0, None, None, None, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FIRST_TYPES)], _FIRST_NAMES)
        held.append(v)
        size += len(v)
        if size >= 1_500_000:
            if (out := common()) is not None:
                yield out
            held, size = [], 0
    if (out := common()) is not None:
        yield out


# --- signatures -------------------------------------------------------------------------------------------------------


def signatures(v: np.ndarray, first: np.ndarray, frequent: np.ndarray, levels: dict[int, int], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets of a batch."""
    n = np.diff(first)
    own = band(n)
    out = []
    rare = np.ones(len(v), bool)
    if len(frequent) and len(v):
        at = np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)
        rare = frequent[at] != v
    content = mix(v ^ _U(0xA0761D6478BD642F))
    for b in np.unique(np.concatenate([own, own + 1])).tolist():
        takes = (n > 0) & ((own == b) | ((own + 1 == b) & (4 * n // 3 >= GROWTH**b)))
        if not takes.any():
            continue
        mine = np.repeat(takes, n)
        rows = np.repeat(np.arange(len(n)), n)[mine]
        place = _place(v[mine], parts_of(b, levels.get(b, 0)), seed) | (~rare[mine]).astype(_U) << _U(63)
        order = np.lexsort((place, rows))
        rows, place = rows[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])]))
        total = np.add.reduceat(content[mine][order], starts)
        who, where = rows[starts], place[starts]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        keep = rank <= differences(n)[who]
        out.append((mix(total[keep] + mix(where[keep] + _U(b + 1) + _U(seed << 8))), who[keep]))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in out]), np.concatenate([r for _, r in out])


def _sign(shared, seed: int, wanted=None):
    """Arrow pass that emits (signature, doc_id); `wanted`: a bitmap of the documents of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, levels = shared.value
        seen: set[bytes] = set()
        for b in pieces(_filtered(batches, wanted), "text"):
            v, first = sets_of(b.column(1))
            if wanted is None:
                # equal sets are linked already: one of a task's copies is enough
                new = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    key = hash(v[first[i] : first[i + 1]].tobytes())
                    new[i] = key not in seen
                    seen.add(key)
                n = np.where(new, np.diff(first), 0)
                v = v[np.repeat(new, np.diff(first))]
                first = np.concatenate([[0], np.cumsum(n)])
            s, rows = signatures(v, first, frequent, levels, seed)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(ids[rows], pa.int64())], ["signature", "doc_id"])

    return run


# --- documents of interest, as a bitmap of fixed size -----------------------------------------------------------------

BITMAP_BITS = 24


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - BITMAP_BITS)).astype(np.int64)


def _filtered(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if wanted is None:
            yield b
        else:
            bit = _bit(b.column(0).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array((wanted.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)))


def _bitmap(ids: DataFrame):
    """A bitmap of 2^24 hashed ids: lets through every listed document and few others. Its size does not depend on the input;
    a fuller bitmap lets through more and never less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
        for b in batches:
            bit = _bit(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(packed, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
        packed = packed.reshape(-1, 64)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bits = np.frombuffer(x, np.uint8)
                now[k] = now[k] | bits if k in now else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int64()), pa.array([x.tobytes() for x in now.values()], pa.binary())], ["block", "bits"])

    spark = ids.sparkSession
    got = ids.mapInArrow(run, "block long, bits binary").repartition("block").mapInArrow(merge, "block long, bits binary").toArrow()
    bits = np.zeros(((1 << BITMAP_BITS) // 512, 64), np.uint8)
    for k, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        bits[k] = np.frombuffer(x, np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


# --- pairs ------------------------------------------------------------------------------------------------------------


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        ok = np.array([4 * min(x, y) >= 3 * max(x, y) and 7 * least_difference(p, q) <= x + y for x, y, p, q in zip(n, m, b.column(4).to_pylist(), b.column(5).to_pylist())], bool)
        yield b.filter(pa.array(ok)).select(["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=64)
    def of(text: str) -> np.ndarray:
        return sets_of(pa.array([text], pa.large_string()))[0]

    for b in batches:
        links = []
        for s, t in zip(b.column(2), b.column(3)):
            x, y = of(s.as_py()), of(t.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            links.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield b.filter(pa.array(links, pa.bool_())).select(["a", "b"])


def _cell(comp, n, counts, docs, asks) -> list[tuple[int, int]]:
    """Possible pairs of one cell: rows that ask against all rows, of different components."""
    sizes = np.array([len(c) for c in counts])
    by_size = {z: (rows := np.flatnonzero(sizes == z), np.frombuffer(b"".join(counts[i] for i in rows), np.uint8).reshape(len(rows), z)) for z in np.unique(sizes).tolist()}
    out = []
    for z, (rows, bits) in by_size.items():
        mine = asks[rows]
        q, qb = rows[mine], bits[mine]
        for y in (z // 2, z, 2 * z):
            if y not in by_size or not len(q):
                continue
            other, ob = by_size[y]
            size = min(y, z)
            word = np.uint64 if size % 8 == 0 else np.uint8
            u, v = (np.ascontiguousarray(fold(t, size)).view(word) for t in (qb, ob))
            step = max(1, (8 << 20) // max(1, v.nbytes))
            for at in range(0, len(q), step):
                i = q[at : at + step]
                apart = np.bitwise_count(u[at : at + step, None, :] ^ v[None, :, :]).sum(2, dtype=np.int64)
                both = n[i][:, None] + n[other][None, :]
                ok = (7 * apart <= both) & (comp[i][:, None] != comp[other][None, :]) & (7 * np.minimum(n[i][:, None], n[other][None, :]) >= 3 * both)
                out += [(docs[i[j]], docs[other[k]]) for j, k in zip(*np.nonzero(ok))]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in their order: (family, x, y, asks, doc_id, component, n, counts). One cell is held at a time."""
    key, held = None, []

    def pairs() -> list[tuple[int, int]]:
        asks, docs, comp, n, counts = zip(*held)
        return _cell(np.array(comp), np.array(n), counts, docs, np.array(asks, bool)) if any(asks) and len(held) > 1 else []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([max(r) for r in rows], pa.int64()), pa.array([min(r) for r in rows], pa.int64())], ["a", "b"])

    out: list[tuple[int, int]] = []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for f, x, y, *row in zip(*columns):
            if (f, x, y) != key:
                if held:
                    out += pairs()
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
                key, held = (f, x, y), []
            held.append(row)
    if held:
        out += pairs()
    yield batch(out)


def _family_pairs(groups: DataFrame, classes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Possible pairs between each family's outsiders and its members."""
    label = lambda name: classes.toDF(f"{name}_node", f"{name}_component")
    met = groups.select("doc_id", "center").distinct().join(label("c"), F.col("center") == F.col("c_node"), "left")
    family = met.select("doc_id", F.coalesce("c_component", "center").alias("family")).distinct()
    family = cut(family.join(label("d"), F.col("doc_id") == F.col("d_node"), "left").select("doc_id", "family", F.coalesce("d_component", "doc_id").alias("component")))
    outside = F.col("component") != F.col("family")
    sizes = family.groupBy("family").agg(F.count("*").alias("all"), F.count_if(outside).alias("out")).filter("out > 0")
    sized = family.join(sizes, "family").withColumns({"columns": F.ceil(F.col("all") / F.lit(float(block))), "lines": F.ceil(F.col("out") / F.lit(float(block))), "pick": F.xxhash64("doc_id")})
    asking = sized.filter(outside).select("family", F.pmod("pick", "lines").alias("x"), F.explode(F.expr("sequence(0L, columns - 1)")).alias("y"), F.lit(True).alias("asks"), "doc_id", "component")
    # every row of a cell counts as a member of it, so outsiders are not sent to their own line twice
    member = sized.select("family", F.explode(F.expr("sequence(0L, lines - 1)")).alias("x"), F.pmod("pick", "columns").alias("y"), F.lit(False).alias("asks"), "doc_id", "component", "pick", "lines")
    member = member.filter(~outside | (F.pmod("pick", "lines") != F.col("x"))).drop("pick", "lines")
    rows = asking.unionByName(member)
    filled = rows.join(sets.filter("n > 0").select(F.col("doc_id").alias("_id"), "n", "counts"), F.col("doc_id") == F.col("_id")).select("family", "x", "y", "asks", "doc_id", "component", "n", "counts")
    dealt = filled.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    return dealt.mapInArrow(_compare, "a long, b long").filter("a <> b").distinct()


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: sizes and sketches first, then whole texts."""
    s = sets.filter("n > 0").select("doc_id", "n", "counts")
    left, right = (s.toDF(k, f"n_{k}", f"c_{k}") for k in ("a", "b"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(_possible, "a long, b long")
    near = cut(near.distinct())
    wanted = _bitmap(near.select(F.explode(F.array("a", "b")).alias("id")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filtered(batches, wanted)

    texts = docs.select("doc_id", "text").mapInArrow(some, "doc_id long, text string")
    joined = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_verified, "a long, b long").distinct()


def _grouped(rows: DataFrame) -> DataFrame:
    """(signature, doc_id) rows of signatures with several documents, with the smallest of them."""
    w = Window.partitionBy("signature")
    return rows.withColumns({"last": F.max("doc_id").over(w), "center": F.min("doc_id").over(w)}).filter("center < last").drop("last")


def _frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The elements of the highest document counts, ascending; as many powers of two of counts as fit into `most`.

    Which elements these are decides the order of parts only, never a result.
    """
    summed = cut(counts.groupBy("element").agg(F.sum("documents").alias("documents")).filter("documents >= 4"))
    sizes = summed.groupBy(F.floor(F.log2("documents")).alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = 2 ** r["power"]
    if least is None:
        return np.zeros(0, _U)
    got = summed.filter(F.col("documents") >= least).select("element").toArrow()
    return np.sort(got.column(0).to_numpy().view(_U))


def near_classes(documents: DataFrame, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every row.

    Null and empty texts and texts without words have size 0 and no link. Rows with one doc_id count as one document: each
    row has its own size, and the links of all its rows hold. Rows with a null doc_id have no links and a null component.
    An empty table gives an empty result; other columns are left out.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    table = cut(docs.mapInArrow(_first_pass, _FIRST))
    sets = table.filter("element is null").select("doc_id", "n", "h1", "h2", "counts", "own", "next")
    docs = docs.filter("doc_id is not null and text is not null")
    named = sets.filter("doc_id is not null")
    often = _frequent(table.filter("element is not null"), frequent)
    sized = named.filter("n > 0").withColumn("band", F.floor(F.log(float(GROWTH), F.col("n") + 0.5)).cast("int"))
    wanted_level = sized.select("band", F.col("own").alias("level")).unionByName(sized.filter("next is not null").select(F.col("band") + 1, F.col("next")).toDF("band", "level"))
    levels = {r["band"]: r["level"] for r in wanted_level.groupBy("band").agg(F.max("level").alias("level")).collect()}
    shared = spark.sparkContext.broadcast((often, levels))

    equal = named.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"))
    same = named.join(equal, ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).filter("a <> b")

    # 2. stars
    groups = cut(_grouped(docs.mapInArrow(_sign(shared, 0), "signature long, doc_id long")))
    stars = groups.filter("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    links = cut(_links(stars, docs, named).unionByName(same))
    classes = cut(components(links))

    # 3. families
    found = cut(_links(_family_pairs(groups, classes, named, block), docs, named))
    if not found.isEmpty():
        classes = cut(components(links.unionByName(found)))

    out = sets.join(classes, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, in all their columns, without near duplicates: of each class of linked documents the one with the
    smallest doc_id stays.

    Rows that repeat one doc_id, and rows without one, stay once per sequence of words (A-Z lower-cased). Rows without words are
    linked with nothing and stay, all of them. An empty table gives an empty result.
    """
    kept = near_classes(docs.select("doc_id", "text")).filter("component_id = doc_id")
    kept = cut(kept.groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_rows")))
    x = docs.join(kept, F.col("doc_id") == F.col("_keep"), "left").filter("doc_id IS NULL OR _keep IS NOT NULL")
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    repeated = F.col("doc_id").isNull() | (F.col("_rows") > 1)
    rest = x.filter(repeated).withColumn("_words", F.array_join(words, " "))
    once = rest.filter("_words <> ''").withColumn("_words", F.sha2("_words", 256)).dropDuplicates(["doc_id", "_words"])
    parts = [x.filter(~repeated), once, rest.filter("_words = ''")]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
