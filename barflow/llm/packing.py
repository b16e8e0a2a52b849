"""Packing documents into as few sequences of a fixed length as possible.

1. Spark tasks tokenize whole texts; a document longer than a sequence is cut into full pieces, the first piece being the
   shorter one. Full pieces are sequences of their own; all others are items of 1 to `length - 1` tokens.
2. Items are dealt over partitions by a hash and packed there by best fit, longest first. Dual feasible functions give a
   lower bound of each partition's bin count: a partition that reaches it is certified.
   In one that does not, bins with gaps exchange items and what is left in bins with gaps is packed anew.
3. Bins with a gap of partitions that are not certified are opened; their items are dealt anew over other partitions and
   packed again, until all are certified or a round saves no bin. Full bins stay as they are.

A task holds the lengths of about `per_partition` items, never texts, and the number of partitions follows the number of
items, so no task and no group grows with the input.

Ids are those of the tokenizer file. Its merge ranks are read from it and applied by a faster library with the same
result; texts that hold the file's special strings, which that library treats as plain text, go through the original.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import cut

LENGTH = 1024
END = 2
PER_PARTITION = 50_000


# --- tokens ---------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def original_of(path: str):
    """The file's own library, made only where it is needed: it takes some 100 MB in every worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def fast_of(path: str):
    """(the faster library or None, special strings) of a byte-level BPE tokenizer file, one per worker process."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain:
        return None, special
    # fixed values: the pattern of byte-level BPE
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies print visible bytes as themselves and the others, in order, from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}


def ids_of(text: str | None, path: str) -> np.ndarray:
    fast, special = fast_of(path)
    if not text:
        return np.zeros(0, np.uint32)
    if fast is None or any(s in text for s in special):
        return np.array(original_of(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a document's ids followed by `end`; null texts are empty, so every row gives a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            out = defaultdict(list)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = memoryview(ids_of(text.as_py(), tokenizer).astype("<u4", copy=False).tobytes() + tail)
                n, at, k = len(raw) // 4, 0, 0
                step = n % length or length
                while at < n:
                    for name, v in zip(names, (doc, k, at, step, zlib.crc32(raw[4 * at : 4 * (at + step)]))):
                        out[name].append(v)
                    at, step, k = at + step, length, k + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], list(names))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# --- bins -----------------------------------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of the plain sum and of two families of dual feasible functions.

    f_k (Fekete and Schepers) rounds (k + 1) x down to whole k-ths where that is not whole; f_e counts items above
    size - e fully and those below e not at all.
    """
    if not len(lengths):
        return 0
    x, n = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((x * n).sum()) // size)
    for k in range(1, 21):
        y = (k + 1) * x
        best = max(best, -(-int((np.where(y % size == 0, x * k, (y // size) * size) * n).sum()) // (k * size)))
    for e in np.unique(np.concatenate([x[2 * x <= size], (size - x[2 * x > size]) + 1])):
        if 0 < 2 * e <= size:
            best = max(best, -(-int((np.where(x > size - e, size, np.where(x < e, 0, x)) * n).sum()) // size))
    return best


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of every item: longest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free room
    rooms = 0  # bit r: some bin has room r
    made = 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, made
            made += 1
        room -= x
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
        bins[i] = b
    return bins


def exchange(lengths: np.ndarray, bins: np.ndarray, size: int, steps: int = 10) -> np.ndarray:
    """The same packing after bins exchanged items, with no more bins than before.

    The bin with the smallest gap fills up: it takes an item of exactly that length from another bin with a gap, or gives one
    of its own for an item longer by the gap. The gap passes on to the other bin, so that gaps gather in few bins. Where no bin
    with a gap has such an item, a full bin gives it and takes over the gap, up to `steps` times per bin with a gap. What is
    left in bins with gaps is packed anew by best fit.
    """
    bins = bins.copy()
    room = size - np.bincount(bins, lengths).astype(np.int64)
    inside: list[list[int]] = [[] for _ in range(len(room))]
    by_length: list[tuple[dict[int, int], dict[int, int]]] = [({}, {}) for _ in range(size + 1)]  # items of full bins, of others
    for i, (x, b) in enumerate(zip(lengths.tolist(), bins.tolist())):
        inside[b].append(i)
        by_length[x][int(room[b] > 0)][i] = b
    queue = [(int(g), b) for b, g in enumerate(room) if g]
    heapq.heapify(queue)
    through_full = steps * len(queue)

    def partner(length: int, b: int, gap: bool) -> int | None:
        return next((i for i, other in by_length[length][gap].items() if other != b), None) if length < size else None

    def longer(b: int, gap: bool) -> tuple[int | None, int | None]:
        for mine in inside[b]:
            if (i := partner(int(lengths[mine]) + int(room[b]), b, gap)) is not None:
                return mine, i
        return None, None

    def listed(b: int, gap: bool) -> None:
        for i in inside[b]:
            x = int(lengths[i])
            by_length[x][not gap].pop(i, None)
            by_length[x][gap].pop(i, None)
            by_length[x][gap][i] = b

    def shift(i: int, b: int) -> None:
        old = int(bins[i])
        inside[old].remove(i), inside[b].append(i)
        bins[i] = b
        room[old] += lengths[i]
        room[b] -= lengths[i]

    while queue:
        gap, b = heapq.heappop(queue)
        if gap != room[b] or not inside[b]:
            continue
        give, take = None, partner(gap, b, True)
        if take is None:
            give, take = longer(b, True)
        if take is None and through_full > 0:
            through_full -= 1
            give, take = longer(b, False)
        if take is None:
            continue  # its gap stays, and so do its items for others to take
        other = int(bins[take])
        shift(take, b)
        if give is not None:
            shift(give, other)
        listed(b, False), listed(other, True)
        heapq.heappush(queue, (int(room[other]), other))
    loose = np.flatnonzero(room[bins] > 0)
    if len(loose):
        again = best_fit(lengths[loose], size)
        if again.max() + 1 < len(np.unique(bins[loose])):
            bins[loose] = len(room) + again
    return np.unique(bins, return_inverse=True)[1]


def _pack(size: int):
    """Packs one partition of (item, length); `certified`: its bin count reaches the lower bound.

    Where best fit decreasing does not reach the bound, bins with gaps exchange items until that saves no bin.
    """

    def run(pdf):
        n = pdf["length"].to_numpy(np.int64)
        order = np.lexsort((pdf["item"].to_numpy(np.int64), n))  # reruns agree whatever order the rows come in
        pdf, n = pdf.iloc[order], n[order]
        bins, bound, before = best_fit(n, size), lower_bound(n, size), None
        while len(n) and bins.max() + 1 > bound and (before is None or bins.max() < before):
            before = bins.max()
            bins = exchange(n, bins, size)
        filled = np.bincount(bins, n).astype(np.int64)
        return pdf[["item", "length", "part"]].assign(bin=bins, room=size - filled[bins], certified=len(filled) <= bound)

    return run


#: bits of a sequence's number: its bin in the partition, the partition, the round; whole sequences have a bit of their own
BIN, PART, WHOLE = 20, 34, 62


def pack(items: DataFrame, size: int = LENGTH, per_partition: int = PER_PARTITION) -> DataFrame:
    """(item, length) to (item, length, sequence): `sequence` numbers the bin, by round, partition and place, so no two share one.

    The items of open bins of uncertified partitions are exchanged and packed again as long as that leaves fewer open bins. Rows
    with equal items are packed each; an empty table gives no rows.
    """
    schema = "item long, length long, part long, bin long, room long, certified boolean"
    n = items.count()
    parts = max(1, -(-n // per_partition))
    todo, closed, before, turn = items, None, None, 0
    while True:
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(size), schema))
        named = packed.withColumn("sequence", (F.lit(turn).cast("long") * 2**PART + F.col("part")) * 2**BIN + F.col("bin"))
        bins = packed.filter("room > 0 and not certified").agg(F.count_distinct("part", "bin"), F.count("*")).first()
        last = parts == 1 or not bins[0] or (before is not None and bins[0] >= before)
        keep = named if last else named.filter("room = 0 or certified")
        keep = keep.select("item", "length", "sequence")
        closed = keep if closed is None else closed.unionByName(keep)
        if last:
            return closed
        before, turn = bins[0], turn + 1
        todo = named.filter("room > 0 and not certified").select("item", "length")
        parts = max(1, -(-bins[1] // per_partition))


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, per_partition: int = PER_PARTITION) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of `docs`.

    Null and empty texts are one piece of one id. Repeated rows are packed each for itself. An empty table gives an empty
    result. Other columns are left out. sequence_id is any number, the same for all pieces of a sequence.
    """
    table = cut(pieces(docs, tokenizer, length, end).withColumn("row", F.monotonically_increasing_id()))
    small = table.filter(F.col("length") < length)
    placed = pack(small.select(F.col("row").alias("item"), "length"), length, per_partition)
    placed = placed.select(F.col("item").alias("_row"), F.col("sequence").alias("sequence_id"))
    full = table.filter(F.col("length") == length).withColumns({"sequence_id": F.col("row") + F.lit(2**WHOLE), "offset": F.lit(0).cast("long")})
    at = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    joined = small.join(placed, F.col("row") == F.col("_row")).withColumn("offset", F.coalesce(F.sum("length").over(at), F.lit(0)).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return joined.select(*columns).unionByName(full.select(*columns))
