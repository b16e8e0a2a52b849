"""Text knowledge base: chunks, search, concept graph, manifest, checks and retrieval evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import text as X
from barflow.operators.joins import asof_last, find_patterns
from barflow.session import cut, spread

# Output fields every concept must promise, and the chunk limit of a concept's manifest entry.
CONTRACT = ["操作级别", "走势定位", "买卖点", "结构依据", "图形参照", "置信度", "失效条件"]
MANIFEST_LIMIT = 200
QUALITATIVE = "qualitative"


# ---- pages, sections, chunks ----------------------------------------------------------------------------------


def split_pages(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Numbered pages between form feeds; empty pages keep their number but are dropped."""
    x = df.select(key, F.posexplode(F.split(text, "\f")).alias("p", "raw"))
    t = F.regexp_replace("raw", r"^\s+|\s+$", "")
    return x.select(key, (F.col("p") + 1).alias("page"), t.alias("text")).filter("text <> ''")


def split_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections under headings of level one to three with line ranges; lines before the first heading are left out,
    a text without headings is one section."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^#{1,3}\s+(.+?)\s*$", 1)
    w = Window.partitionBy(key).orderBy("n")
    x = lines.withColumns({"head": head, "line_no": F.col("n") + 1})
    x = x.withColumn("section", F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = F.max("section").over(Window.partitionBy(key))
    x = x.withColumn("heads", heads).filter((F.col("section") > 0) | (F.col("heads") == 0))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    g = x.groupBy(key, "section").agg(
        F.max(F.when(F.col("head") != "", F.col("head"))).alias("heading"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
        F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("text"),
    )
    return g.filter("text <> ''")


def concepts_in(docs: DataFrame, concepts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Concepts of each text: any keyword contained, case kept. concepts: (concept, keyword)."""
    hits = find_patterns(docs, concepts.select("keyword"), key, text)
    return hits.join(concepts, F.col("pattern") == F.col("keyword")).groupBy(key).agg(F.sort_array(F.collect_set("concept")).alias("concepts"))


def page_chunks(pages: DataFrame, toc: DataFrame, concepts: DataFrame) -> DataFrame:
    """Window chunks of pages with id, lesson, concepts and at most 80 keywords. pages: (page, text); toc: (page, lesson)."""
    with_lesson = asof_last(pages, toc, "page", "lesson")
    w = spread(with_lesson).select("page", "lesson", F.posexplode(X.windows("text")).alias("i", "w")).filter("w.text <> ''")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    chunks = w.select(
        F.concat(F.lit("pdf.p"), F.format_string("%04d", F.col("page").cast("bigint")), F.lit("."), F.format_string("%02d", F.col("i") + 1)).alias("chunk_id"),
        F.lit("source_page_window").alias("kind"), "page", "lesson", F.col("w.begin").alias("char_start"), F.col("w.end").alias("char_end"), F.col("w.text").alias("text"),
    )
    hit = concepts_in(chunks, concepts, "chunk_id")
    kw = F.slice(F.array_sort(X.terms("text", min_len=4)), 1, 80)
    return chunks.join(hit, "chunk_id", "left").withColumns({"concepts": F.coalesce("concepts", F.array().cast("array<string>")), "keywords": kw})


def section_chunks(sections: DataFrame, key: str) -> DataFrame:
    cid = F.concat(F.lit("fast."), F.col(key).cast("string"), F.lit("."), F.format_string("%02d", F.greatest("section", F.lit(1))), F.lit("."), X.slug(F.coalesce("heading", F.col(key).cast("string"))))
    return sections.select(cid.alias("chunk_id"), key, "heading", "line_start", "line_end", "text")


# ---- trees ----------------------------------------------------------------------------------------------------


def flatten_tree(nodes: DataFrame, sep: str = "/") -> DataFrame:
    """(id, path, is_leaf) from (id, parent, title). Paths double in length each round, so a tree of depth d takes
    about log2(d) joins whatever its size."""
    kids = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct().withColumn("has_kids", F.lit(True))
    cur = nodes.select("id", F.col("title").alias("path"), F.col("parent").alias("up"))
    while True:
        above = cur.select(F.col("id").alias("up"), F.col("path").alias("path_up"), F.col("up").alias("up2"))
        cur = cut(
            cur.join(above, "up", "left").select(
                "id", F.when(F.col("path_up").isNotNull(), F.concat("path_up", F.lit(sep), "path")).otherwise(F.col("path")).alias("path"), F.col("up2").alias("up")
            )
        )
        if cur.filter(F.col("up").isNotNull()).isEmpty():
            break
    return cur.join(kids, "id", "left").select("id", "path", F.col("has_kids").isNull().alias("is_leaf"))


def tree_chunks(nodes: DataFrame) -> DataFrame:
    """Chunks of tree nodes (id, title, raw_text): markers stripped, short ones dropped, unique ids by suffix."""
    body = F.regexp_replace(F.regexp_replace("raw_text", r"<!--\s*[^>]*-->", ""), r"^\s+|\s+$", "")
    x = nodes.withColumn("text", body).filter(F.length("text") >= 80)
    marks = X.page_numbers(F.concat_ws("\n", "raw_text", "title"))
    x = x.withColumns({"pages": marks, "lesson": X.lesson_of(F.concat_ws("\n", "title", F.substring("raw_text", 1, 800)))})
    x = x.withColumns({"page_start": F.array_min("pages"), "page_end": F.array_max("pages")})
    # number 0 stands for none, of lessons and of pages
    prefix = F.when(F.col("lesson") > 0, F.format_string("l%03d", F.col("lesson"))).otherwise(F.lit("front"))
    span = F.when((F.col("page_end") > 0) & (F.col("page_end") != F.col("page_start")), F.format_string("-p%04d", F.col("page_end"))).otherwise(F.lit(""))
    base = F.when(F.col("page_start") > 0, F.concat(F.lit("pageindex."), prefix, F.format_string(".p%04d", F.col("page_start")), span)).otherwise(
        F.concat(F.lit("pageindex.node"), F.format_string("%04d", F.col("id").cast("bigint")))
    )
    x = x.withColumn("base_id", base)
    n = F.row_number().over(Window.partitionBy("base_id").orderBy("id"))
    return x.withColumn("chunk_id", F.when(n == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("."), n.cast("string")))).select("chunk_id", "id", "page_start", "page_end", "lesson", "text")


def toc_rows(pages: DataFrame, book: str = "book") -> DataFrame:
    """Table-of-contents lines of the first four pages with text: lesson, title, date, page; the last line of a lesson counts."""
    line = F.regexp_replace(F.regexp_replace("text", r"教你炒股票\s*(\d+)\s*：\s*", "\n教你炒股票 $1："), r"\s*\n\s*", "\n")
    first = F.row_number().over(Window.partitionBy(book).orderBy("page"))
    front = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("n", first).filter("n <= 4")
    rows = front.select(book, "page", F.posexplode(F.split(line, "\n")).alias("at", "line"))
    rx = r"^教你炒股票\s*(\d{1,3})\s*[：:]\s*(.*?)\(\s*(\d{4}-\d{2}-\d{2}[^)]*)\)\s*[.。·…\s]*(\d{1,4})\s*$"
    g = lambda i: F.regexp_extract("line", rx, i)
    x = rows.filter(F.col("line").rlike(rx)).select(book, F.struct("page", "at").alias("place"), g(1).cast("int").alias("lesson"), X.squeeze(F.regexp_replace(g(2), r"[.。·…\s]+$", "")).alias("title"), g(3).alias("date"), g(4).cast("int").alias("toc_page"))
    last = x.filter("lesson BETWEEN 1 AND 108").groupBy(book, "lesson").agg(F.max_by(F.struct("title", "date", "toc_page"), "place").alias("r"))
    return last.select(book, "lesson", "r.title", "r.date", "r.toc_page")


def toc_from_headings(pages: DataFrame, toc: DataFrame, book: str = "book") -> DataFrame:
    """Lessons the contents page misses, taken from the first dated heading after page four."""
    rx = r"教你炒股票\s*(\d{1,3})\s*[：:]?\s*([\s\S]{0,180}?)\(\s*(\d{4}-\d{2}-\d{2}[^)]*)\)"
    all_of = lambda i: F.regexp_extract_all("text", F.lit(rx), F.lit(i))
    z = F.arrays_zip(all_of(1).alias("a"), all_of(2).alias("b"), all_of(3).alias("c"))
    x = pages.filter("page > 4").select(book, "page", F.posexplode(z).alias("i", "m"))
    x = x.select(book, F.col("m.a").cast("int").alias("lesson"), F.struct("page", "i", X.squeeze(F.col("m.b")).alias("title"), F.col("m.c").alias("date")).alias("s"))
    first = x.filter("lesson BETWEEN 1 AND 108").groupBy(book, "lesson").agg(F.min("s").alias("s"))
    new = first.join(toc.select(book, "lesson"), [book, "lesson"], "left_anti")
    title = F.when(F.col("s.title") == "", F.concat(F.lit("教你炒股票 "), F.col("lesson").cast("string"))).otherwise(F.col("s.title"))
    return toc.unionByName(new.select(book, "lesson", title.alias("title"), F.col("s.date").alias("date"), F.col("s.page").alias("toc_page")))


def heading_offsets(headings: DataFrame, toc: DataFrame, page_starts: DataFrame, book: str = "book") -> DataFrame:
    """Where each lesson starts. headings: (book, lesson, page, pos); page_starts: (book, page, pos).

    The nearest heading at most 12 pages from the expected page and after the previous lesson wins; else the expected
    page's start; else the first later heading; else the previous lesson's place. Each choice depends on the one
    before, so a book's lessons (108 at most) are folded as one short array."""
    cand = headings.filter("page > 4").groupBy(book, "lesson").agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("c"))
    starts = toc.select(book, "lesson", "toc_page").join(page_starts.select(book, F.col("page").alias("toc_page"), F.col("pos").alias("page_pos")), [book, "toc_page"], "left")
    rows = starts.join(cand, [book, "lesson"], "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<pos:int,page:int>>")))
    packed = rows.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("lesson", "toc_page", "page_pos", "c"))).alias("ls"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<lesson:int,pos:int>>").alias("out"))

    def step(acc: Column, l: Column) -> Column:
        later = F.filter(l["c"], lambda x: x["pos"] > acc["at"])
        near = F.filter(later, lambda x: F.abs(x["page"] - l["toc_page"]) <= 12)
        best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["page"] - l["toc_page"]).alias("d"), x["pos"].alias("pos"))))["pos"]
        pos = F.coalesce(best, F.when(l["page_pos"] > acc["at"], l["page_pos"]), F.array_min(F.transform(later, lambda x: x["pos"])), acc["at"]).cast("int")
        return F.struct(F.greatest(acc["at"], pos).alias("at"), F.concat(acc["out"], F.array(F.struct(l["lesson"].alias("lesson"), pos.alias("pos")))).alias("out"))

    return packed.select(book, F.inline(F.aggregate("ls", start, step)["out"]))


# ---- search ---------------------------------------------------------------------------------------------------


def query_table(queries: DataFrame) -> DataFrame:
    """(qid, query) with folded phrase and terms, longest first."""
    return queries.select("qid", "query", F.trim(F.lower("query")).alias("phrase"), X.by_length(X.terms("query", min_len=3)).alias("terms"))


def scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of every match. docs: (doc_id, title, text).

    One pass over the texts finds phrases and terms of all queries; the rest is an equi-join on the pattern."""
    q = query_table(queries)
    hay = docs.select("doc_id", X.squeeze(F.lower("text")).alias("text"))
    pats = q.select(F.explode(F.concat(F.array("phrase"), F.col("terms"))).alias("pattern"))
    hits = find_patterns(hay, pats, "doc_id").join(docs.select("doc_id", F.lower("title").alias("title")), "doc_id")
    wanted = q.select("qid", F.explode("terms").alias("pattern"), F.lit(False).alias("whole")).unionByName(
        q.filter("phrase <> ''").select("qid", F.col("phrase").alias("pattern"), F.lit(True).alias("whole"))
    )
    part = F.when(F.col("whole"), 80.0 + F.least(F.length("pattern"), F.lit(40))).otherwise(
        F.least("n", F.lit(8)) * X.weight(F.col("pattern"), F.contains(F.col("title"), F.col("pattern")))
    )
    return hits.join(wanted, "pattern").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top k documents per query, ties by id; the rank filter is applied before the shuffle as well."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores(docs, queries).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_results(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    top = search(docs, queries, k)
    x = top.join(docs, "doc_id").join(query_table(queries), "qid")
    return x.select("qid", "rank", "doc_id", F.round("score", 3).alias("score"), "title", X.snippet(F.col("text"), F.col("query"), F.col("terms")).alias("snippet"))


def lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks by id; the id is the first present of four fields, else the line number."""
    fields = [f for f in ("chunk_id", "chunkId", "id", "chunk") if f in chunks.columns]
    cid = F.coalesce(*[F.col(f).cast("string") for f in fields], F.concat(F.lit("line:"), F.col("_line").cast("string")))
    return chunks.withColumn("cid", cid).join(wanted, "cid", "left_semi")


def card_search(cards: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key, score, exact): an exact key beats everything, else phrase and term presence. cards: (key, text)."""
    q = query_table(queries)
    exact = cards.select("key", F.lower("key").alias("folded")).join(q.select("qid", F.lower("query").alias("folded")), "folded").select("qid", "key").distinct()
    hay = cards.select("key", F.lower("text").alias("text"))
    pats = q.select(F.explode(F.concat(F.array("phrase"), F.col("terms"))).alias("pattern"))
    hits = find_patterns(hay, pats, "key")
    wanted = q.select("qid", F.explode("terms").alias("pattern"), F.lit(False).alias("whole")).unionByName(q.filter("phrase <> ''").select("qid", F.col("phrase").alias("pattern"), F.lit(True).alias("whole")))
    part = F.when(F.col("whole"), 50.0 + F.least(F.length("pattern"), F.lit(30))).otherwise(2.0 + F.least(F.length("pattern"), F.lit(8)))
    ranked = hits.join(wanted, "pattern").groupBy("qid", "key").agg(F.sum(part).alias("score"))
    rest = ranked.join(exact.select("qid").distinct(), "qid", "left_anti").withColumn("exact", F.lit(False))
    return exact.withColumns({"score": F.lit(None).cast("double"), "exact": F.lit(True)}).unionByName(rest)


def any_token(cards: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """Cards containing any blank-separated token of the query, at most `most` per query in key order (as asked for)."""
    tokens = queries.select("qid", F.explode(F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")).alias("pattern")).distinct()
    hits = find_patterns(cards.select("key", F.lower("text").alias("text")), tokens.select("pattern"), "key")
    pairs = hits.join(tokens, "pattern").select("qid", "key").distinct()
    w = Window.partitionBy("qid").orderBy("key")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


# ---- graph, manifest, checks ----------------------------------------------------------------------------------


def keep_last(nodes: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    cols = [c for c in nodes.columns if c not in (key, order)]
    return nodes.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("v")).select(key, "v.*")


def graph(concepts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept, page and chunk nodes with typed edges. concepts: (concept, keyword, page); chunks: (chunk_id, title, page, concepts)."""
    node = lambda df, kind, cid, label, o: df.select(F.concat(F.lit(f"{kind}:"), cid.cast("string")).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), F.lit(o).alias("ord"))
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(f"{ka}:"), a.cast("string")).alias("from"), F.concat(F.lit(f"{kb}:"), b.cast("string")).alias("to"), F.lit(kind).alias("type"))
    c, p = F.col("concept"), F.col("page")
    nodes = (
        node(concepts, "concept", c, c, 1).unionByName(node(concepts, "source_page", p, F.concat(F.lit("p"), p.cast("string")), 2))
        .unionByName(node(chunks, "chunk", F.col("chunk_id"), F.col("title"), 3))
    )
    said = chunks.select("chunk_id", F.explode("concepts").alias("concept"))
    edges = (
        edge(concepts, c, "concept", p, "source_page", "anchored_to").unionByName(edge(said, F.col("chunk_id"), "chunk", c, "concept", "mentions"))
        .unionByName(edge(chunks, F.col("chunk_id"), "chunk", p, "source_page", "from_page"))
    )
    return keep_last(nodes), edges.distinct()


def manifest(chunks: DataFrame, concepts: DataFrame, limit: int = MANIFEST_LIMIT) -> DataFrame:
    """Per concept the number of chunks and the first `limit` ids. Only the listed ids are gathered."""
    said = chunks.select("chunk_id", F.explode("concepts").alias("concept"))
    counts = said.groupBy("concept").agg(F.count("*").alias("chunk_count"))
    w = Window.partitionBy("concept").orderBy("chunk_id")
    listed = said.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).groupBy("concept").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
    x = concepts.select("concept").distinct().join(counts, "concept", "left").join(listed, "concept", "left")
    n = F.coalesce("chunk_count", F.lit(0))
    return x.select("concept", n.alias("chunk_count"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), (n > limit).alias("chunks_truncated"))


#: bytes up to which a file is read whole, in one row; larger ones are read by lines
WHOLE = 64 << 20
#: endings by which Spark would unpack a file that it reads by lines
UNPACKED = r"\.(gz|bz2|lz4|snappy|deflate|zst)$"
PIECE = 4 << 20
BOM = b"\xef\xbb\xbf"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring lines of a file joined to pieces, numbered in the order of the split."""
    seq = 0
    for b in batches:
        path, start = b.column("path").dictionary_encode(), b.column("start").to_numpy()
        new = np.flatnonzero(np.diff(path.indices.to_numpy()) | np.diff(start)) + 1
        lines = b.column("bytes").cast(pa.large_binary())
        at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        rows = []
        for first, end in zip([0, *new], [*new, b.num_rows]) if b.num_rows else ():
            for low in range(int(at[first]), int(at[end]), PIECE):
                piece = lines.buffers()[2][low : min(low + PIECE, int(at[end]))].to_pybytes()
                rows.append((b.column("path")[first].as_py(), b.column("size")[first].as_py(), int(start[first]), seq, piece))
                seq += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["path", "size", "start", "seq", "bytes"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, size, sha256) of files whose pieces come one after the other. Every line came with a line end, the last one even where the
    file has none, and a mark of the encoding at the start was left out; the size tells."""
    path, size, total, plain, marked, rows = None, 0, 0, None, None, []

    def close() -> None:
        if path is None:
            return
        over = total - size
        if over not in (0, 1, -len(BOM), 1 - len(BOM)):
            raise ValueError(f"{path}: {total} bytes were read of {size}")
        h = plain if over >= 0 else marked
        if over in (0, -len(BOM)):
            h.update(b"\n")
        rows.append((path, size, h.hexdigest()))

    for b in batches:
        for n in range(b.num_rows):
            if (name := b.column("path")[n].as_py()) != path:
                close()
                path, size, total, plain, marked = name, b.column("size")[n].as_py(), 0, hashlib.sha256(), hashlib.sha256(BOM)
            piece = memoryview(b.column("bytes")[n].as_buffer())
            for h in (plain, marked):
                # the last byte waits until it is known whether the file has it; it is a line end or in the middle of the file
                h.update(held if total else b"")
                h.update(piece[:-1])
            held, total = bytes(piece[-1:]), total + len(piece)
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), pa.int64(), pa.string()])], ["uri", "size", "sha256"])


def streamed_hashes(spark: SparkSession, path: str, over: int) -> DataFrame:
    """(uri, size, sha256) of the files larger than `over` bytes, of any size, in little memory: their lines are read by many tasks and joined to
    pieces, and a task takes the pieces of a file in order, since a SHA-256 is one chain. Only a single line must fit in memory."""
    meta = {"path": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size"), "start": F.col("_metadata.file_block_start")}
    x = spark.read.option("lineSep", "\n").text(path).filter((meta["size"] > over) & ~F.lower(meta["path"]).rlike(UNPACKED))
    x = x.select(*[c.alias(n) for n, c in meta.items()], F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("bytes"))
    pieces = x.mapInArrow(_pieces, "path string, size long, start long, seq long, bytes binary")
    return pieces.repartition("path").sortWithinPartitions("path", "start", "seq").mapInArrow(_digests, "uri string, size long, sha256 string")


def inventory(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """Assets with hash, size and role. Files over `whole` bytes are hashed piece by piece, except packed ones, which Spark would unpack."""
    f = spark.read.format("binaryFile").load(path)
    # of what is known of a file before it is opened, so that a file that is left out is not read
    large = (F.col("_metadata.file_size") > whole) & ~F.lower("_metadata.file_path").rlike(UNPACKED)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    role = (
        F.when(F.contains(F.col("path"), F.lit("kb/generated")), "generated_index").when(F.contains(F.col("path"), F.lit("kb/sources")), "normalized_source")
        .when(ext == "svg", "visual_card").otherwise("reference")
    )
    out = f.filter(~large).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if not f.select("path", "length").filter(large).isEmpty():
        # the reader of lines has its paths as URIs
        named = f.filter(large).select("path", F.col("_metadata.file_path").alias("uri"))
        out = out.unionByName(named.join(streamed_hashes(spark, path, whole), "uri").drop("uri"))
    return out.select("path", ext.alias("type"), role.alias("role"), "sha256", "size")


def integrity_errors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing assets, size and hash mismatches. Both sides: (path, sha256, size)."""
    x = expected.join(actual.select("path", F.col("sha256").alias("sha_now"), F.col("size").alias("size_now")), "path", "left")
    problem = (
        F.when(F.col("size_now").isNull(), "missing").when(F.col("size") != F.col("size_now"), "size mismatch").when(F.col("sha256") != F.col("sha_now"), "sha256 mismatch")
    )
    return x.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def concept_errors(concepts: DataFrame) -> DataFrame:
    """concepts: (concept, source_pages, chunks, contract): required references and contract fields."""
    missing = F.array_except(F.array(*[F.lit(f) for f in CONTRACT]), F.coalesce("contract", F.array().cast("array<string>")))
    problems = F.concat(
        F.when(F.coalesce(F.size("source_pages"), F.lit(0)) <= 0, F.array(F.lit("source_pages"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, F.array(F.lit("chunks"))).otherwise(F.array().cast("array<string>")),
        missing,
    )
    return concepts.select("concept", F.explode(problems).alias("problem"))


def coverage(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of counts and the risks they imply."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    x = one(chunks, "chunks")
    for df, name in ((nodes, "nodes"), (edges, "edges"), (concepts, "concepts"), (errors, "errors")):
        x = x.crossJoin(F.broadcast(one(df, name)))
    risks = F.filter(
        F.array(
            F.when(F.col("errors") > 0, "validation_errors"), F.when(F.col("chunks") == 0, "no_fulltext").when(F.col("chunks") < 100, "thin_coverage"),
        ), lambda r: r.isNotNull(),
    )
    return x.withColumn("risks", F.when(F.size(risks) > 0, F.array_join(risks, ";")).otherwise("none"))


def boundary_check(concepts: DataFrame) -> DataFrame:
    """Whether each concept states its boundary and names it qualitative."""
    b = F.coalesce("boundary", F.lit(""))
    return concepts.select("concept", (b != "").alias("has_boundary"), F.contains(F.lower(b), F.lit(QUALITATIVE)).alias("has_phrase"))


def retrieval_eval(results: DataFrame, cases: DataFrame, need: int = 2) -> DataFrame:
    """Hit in the first `need` results per case. results: (qid, rank, doc_id); cases: (qid, expected array)."""
    hit = F.exists("expected", lambda e: e == F.col("doc_id"))
    x = cases.join(results.filter(F.col("rank") <= need), "qid", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    g = x.groupBy("qid").agg(F.first("expected").alias("expected"), F.bool_or("hit").alias("top2_ok"), F.bool_or(F.col("hit") & (F.col("rank") == 1)).alias("top1_ok"))
    free = F.size("expected") == 0
    return g.select("qid", (free | F.coalesce("top1_ok", F.lit(False))).alias("top1_ok"), (free | F.coalesce("top2_ok", F.lit(False))).alias("passed"))
