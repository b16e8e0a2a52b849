"""KB rows and text sources over documents, conversations, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import text as X
from barflow.operators.joins import asof_last, find_patterns
from barflow.plans import knowledge as K
from barflow.registry.core import query, r
from barflow.sources import tables as T

RX = r"[a-z0-9_./:-]+|[\x{4e00}-\x{9fff}]+"


def terms_sql(col: str, n: int) -> str:
    return f"regexp_extract_all(lower({col}), '{RX}')"


def docs(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))


def kb_queries(spark, sf):
    b = T.load(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


QUERY = """q AS (SELECT item_id AS qid, text AS query FROM benchmark)"""
TERMS = f"""tk AS (SELECT qid, unnest({terms_sql('query', 3)}) AS t FROM q),
qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, t AS term FROM tk UNION ALL SELECT qid, regexp_replace(t, 's+$', '') FROM tk WHERE length(t) > 3) WHERE term <> '')
"""
SCORES = """d AS (SELECT doc_id, text, lower(split_part(text, chr(10), 1)) AS title, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS hay FROM documents),
dt AS MATERIALIZED (SELECT doc_id, term, contains(title, term) AS in_title, (length(hay) - length(replace(hay, term, ''))) // length(term) AS cnt FROM d JOIN (SELECT DISTINCT term FROM qt) ON contains(hay, term)),
parts AS (SELECT qid, doc_id, least(cnt, 8) * (2.0 + least(length(term), 8)) * CASE WHEN in_title THEN 2.5 ELSE 1.0 END AS s FROM dt JOIN qt USING (term)
  UNION ALL SELECT qid, doc_id, 80 + least(length(trim(lower(query))), 40) FROM q JOIN d ON contains(hay, trim(lower(query))) WHERE trim(lower(query)) <> ''),
sc AS (SELECT qid, doc_id, sum(s)::DOUBLE AS score FROM parts GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc) WHERE rank <= 5)
"""
S = "WITH " + QUERY + ", " + TERMS + ", " + SCORES


@query(
    "kb01_terms",
    f"""WITH tk AS (SELECT doc_id, unnest({terms_sql('text', 4)}) AS t FROM documents) SELECT doc_id, count(DISTINCT term) AS n, md5(string_agg(DISTINCT term, ' ' ORDER BY term)) AS h
    FROM (SELECT doc_id, t AS term FROM tk UNION ALL SELECT doc_id, regexp_replace(t, 's+$', '') FROM tk WHERE length(t) > 4) WHERE term <> '' GROUP BY doc_id""",
)
def kb_terms(spark, sf):
    x = docs(spark, sf).select("doc_id", F.array_sort(X.terms("text", min_len=4)).alias("t")).filter(F.size("t") > 0)
    return x.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("h"))


@query("kb01_query_terms", "WITH " + QUERY + ", " + TERMS + " SELECT qid, string_agg(term, '|' ORDER BY -length(term), term) AS terms FROM qt GROUP BY qid")
def query_terms(spark, sf):
    return K.query_table(kb_queries(spark, sf)).select("qid", F.array_join("terms", "|").alias("terms"))


@query("kb02_flatten_record", "SELECT s_suppkey, trim(regexp_replace(s_name || ' ' || n_name || ' ' || n_regionkey || ' ' || s_nationkey || ' a b', '\\s+', ' ', 'g')) AS flat FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def flatten_record(spark, sf):
    s, n = T.load(spark, sf, "supplier"), T.load(spark, sf, "nation")
    x = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", "s_name", F.struct("n_name", F.struct("n_regionkey").alias("inner")).alias("nest"), F.array("s_nationkey").alias("arr"), F.array(F.struct(F.lit(" a ").alias("u")), F.struct(F.lit("b").alias("u"))).alias("list")
    )
    return x.select("s_suppkey", X.flatten_record(x, ["s_name", "nest", "arr", "list"]).alias("flat"))


@query("kb03_scores", S + " SELECT qid, doc_id, round(score, 3) AS score FROM sc")
def kb_scores(spark, sf):
    return K.scores(docs(spark, sf), kb_queries(spark, sf)).select("qid", "doc_id", F.round("score", 3).alias("score"))


@query("kb05_top08_search", S + " SELECT qid, rank, doc_id, round(score, 3) AS score FROM top")
def kb_search(spark, sf):
    return K.search(docs(spark, sf), kb_queries(spark, sf)).select("qid", "rank", "doc_id", F.round("score", 3).alias("score"))


@query(
    "kb04_snippets",
    S
    + """, nd AS (SELECT t.qid, t.rank, d.doc_id, d.text, lower(d.text) AS low, list_concat([trim(lower(q.query))], (SELECT list(term ORDER BY -length(term), term) FROM qt WHERE qt.qid = t.qid)) AS needles FROM top t JOIN d USING (doc_id) JOIN q USING (qid)),
    st AS (SELECT *, coalesce(instr(low, list_filter(needles, lambda x: x <> '' AND contains(low, x))[1]) - 1, 0) AS start FROM nd),
    lr AS (SELECT *, greatest(0, start - 60) AS l, least(length(text), greatest(0, start - 60) + 180) AS r FROM st)
    SELECT qid, rank, doc_id, CASE WHEN l > 0 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, l + 1, r - l), '\\s+', ' ', 'g')) || CASE WHEN r < length(text) THEN '...' ELSE '' END AS snippet FROM lr""",
)
def snippets(spark, sf):
    return K.search_results(docs(spark, sf), kb_queries(spark, sf)).select("qid", "rank", "doc_id", "snippet")


@query("kb06_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) AND doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) AND doc_id % 2 = 1")
def kb_lookup(spark, sf):
    d = T.load(spark, sf, "documents")
    odd = F.col("doc_id") % 2 == 1
    c = d.select("doc_id", "lang", F.when(~odd, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("chunk_id"), F.lit(None).cast("string").alias("id"), F.col("doc_id").alias("_line"))
    b = T.load(spark, sf, "benchmark").select(F.explode(F.array(F.concat(F.lit("c"), F.col("item_id").cast("string")), F.concat(F.lit("line:"), F.col("item_id").cast("string")))).alias("cid"))
    return K.lookup(c, b).select("doc_id", "lang")


CARDS = """cards AS (SELECT c_name AS key, c_name || ' ' || c_mktsegment AS text FROM customer),
q AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey % 2 = 0 THEN 'CUSTOMER#' || lpad((n_nationkey * 7)::VARCHAR, 9, '0') ELSE 'building 0000000' || n_nationkey END AS query FROM nation)
"""


def cards(spark, sf):
    return T.load(spark, sf, "customer").select(F.col("c_name").alias("key"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))


def card_queries(spark, sf):
    k = F.col("n_nationkey")
    exact = F.concat(F.lit("CUSTOMER#"), F.lpad((k * 7).cast("string"), 9, "0"))
    return T.load(spark, sf, "nation").select(k.alias("qid"), F.when(k % 2 == 0, exact).otherwise(F.concat(F.lit("building 0000000"), k.cast("string"))).alias("query"))


@query(
    "kb07_card_search",
    "WITH " + CARDS + ", " + TERMS + """, ex AS (SELECT qid, key FROM q JOIN cards ON lower(key) = lower(query)),
    p AS (SELECT qid, key, 2.0 + least(length(term), 8) AS s FROM cards JOIN qt ON contains(lower(text), term) UNION ALL SELECT qid, key, 50 + least(length(lower(query)), 30) FROM q JOIN cards ON contains(lower(text), lower(query)))
    SELECT qid, key, NULL::DOUBLE AS score, true AS exact FROM ex UNION ALL SELECT qid, key, sum(s)::DOUBLE, false FROM p WHERE qid NOT IN (SELECT qid FROM ex) GROUP BY qid, key""",
)
def card_search(spark, sf):
    return K.card_search(cards(spark, sf), card_queries(spark, sf))


@query(
    "kb22_any_token",
    "WITH " + CARDS + ", tk AS (SELECT DISTINCT qid, unnest(string_split_regex(lower(query), '\\s+')) AS t FROM q) SELECT qid, key, rank FROM (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY key)::INTEGER AS rank FROM (SELECT DISTINCT qid, key FROM cards JOIN tk ON t <> '' AND contains(lower(text), t))) WHERE rank <= 10",
)
def any_token(spark, sf):
    return K.any_token(cards(spark, sf), card_queries(spark, sf))


# The window cuts as a recursion over positions.
WINDOWS = r"""
src AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents),
cut AS (
  SELECT doc_id, t, 0 AS i, 0 AS b, CASE WHEN least(length(t), 900) < length(t) AND stop > 450 THEN stop + 1 ELSE least(length(t), 900) END AS e
  FROM (SELECT *, 900 - nullif(instr(reverse(regexp_replace(substr(t, 1, 900), '。', chr(10), 'g')), chr(10)), 0) AS stop FROM src)
  UNION ALL
  SELECT doc_id, t, i + 1, nb, CASE WHEN ne < length(t) AND nb + stop > nb + 450 THEN nb + stop + 1 ELSE ne END
  FROM (SELECT *, least(length(t), nb + 900) AS ne, 900 - nullif(instr(reverse(regexp_replace(substr(t, nb + 1, 900), '。', chr(10), 'g')), chr(10)), 0) AS stop FROM (SELECT *, greatest(e - 120, b + 1) AS nb FROM cut WHERE e < length(t))))
"""


@query("kb08_windows", "WITH RECURSIVE " + WINDOWS + r" SELECT doc_id, i::INTEGER AS i, b::INTEGER AS char_start, e::INTEGER AS char_end, length(regexp_replace(regexp_replace(substr(t, b + 1, e - b), '^\s+', ''), '\s+$', ''))::INTEGER AS n FROM cut")
def kb_windows(spark, sf):
    x = docs(spark, sf).select("doc_id", F.posexplode(X.windows("text")).alias("i", "w"))
    return x.select("doc_id", "i", F.col("w.begin").alias("char_start"), F.col("w.end").alias("char_end"), F.length("w.text").alias("n"))


CONCEPTS = "concepts AS (SELECT DISTINCT 'c' || item_id % 10 AS concept, word AS keyword FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS word FROM benchmark))"


def concepts(spark, sf):
    b = T.load(spark, sf, "benchmark")
    x = b.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("keyword"))
    return x.select(F.concat(F.lit("c"), (F.col("item_id") % 10).cast("string")).alias("concept"), "keyword").distinct()


@query("join14_concepts_in_text", "WITH " + CONCEPTS + " SELECT doc_id, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM documents JOIN concepts ON contains(text, keyword) GROUP BY doc_id")
def concepts_in_text(spark, sf):
    return K.concepts_in(docs(spark, sf), concepts(spark, sf), "doc_id").select("doc_id", F.array_join("concepts", ",").alias("concepts"))


TOC = "toc AS (SELECT o_orderkey AS page, (o_orderkey // 37)::INTEGER AS lesson FROM orders WHERE o_orderkey % 37 = 5)"


@query("join11_asof_lesson", f"WITH {TOC} SELECT p.page, t.lesson FROM (SELECT doc_id * 3 AS page FROM documents) p ASOF LEFT JOIN toc t ON p.page >= t.page")
def asof_lesson(spark, sf):
    o = T.load(spark, sf, "orders")
    toc = o.filter(F.col("o_orderkey") % 37 == 5).select(F.col("o_orderkey").alias("page"), F.floor(F.col("o_orderkey") / 37).cast("int").alias("lesson"))
    pages = T.load(spark, sf, "documents").select((F.col("doc_id") * 3).alias("page"))
    return asof_last(pages, toc, "page", "lesson", width=16).select("page", "lesson")


def kb_pages(spark, sf):
    return docs(spark, sf).select((F.col("doc_id") + 1).alias("page"), "text")


def kb_toc(spark, sf):
    return T.load(spark, sf, "documents").filter("doc_id % 9 = 3").select((F.col("doc_id") + 1).alias("page"), F.floor(F.col("doc_id") / 9).cast("int").alias("lesson"))


def chunks(spark, sf):
    return K.page_chunks(kb_pages(spark, sf), kb_toc(spark, sf), concepts(spark, sf))


@query("kb09_page_chunks")
def page_chunks(spark, sf):
    return chunks(spark, sf)


def paged(spark, sf):
    """Every line of a document on a page of its own."""
    return T.load(spark, sf, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))


def headed(spark, sf):
    """A heading after every comma."""
    return T.load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\n## ")).alias("text"))


@query("src25_pages", r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) SELECT doc_id, (k + 1)::INTEGER AS page, length(regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', ''))::INTEGER AS n FROM p WHERE regexp_replace(raw, '\s+', '', 'g') <> ''")
def split_pages(spark, sf):
    return K.split_pages(paged(spark, sf), "doc_id").select("doc_id", "page", F.length("text").alias("n"))


@query(
    "src26_sections",
    r"""WITH t AS (SELECT doc_id, replace(text, ', ', chr(10) || '## ') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM t),
    h AS (SELECT *, regexp_extract(line, '^#{1,3}\s+(.+?)\s*$', 1) AS head FROM l), s AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM h),
    z AS (SELECT *, max(sec) OVER (PARTITION BY doc_id) AS heads FROM s)
    SELECT doc_id, sec::BIGINT AS section, max(CASE WHEN head <> '' THEN head END) AS heading, min(n)::INTEGER AS line_start, max(n)::INTEGER AS line_end FROM z WHERE sec > 0 OR heads = 0 GROUP BY doc_id, sec HAVING regexp_replace(string_agg(line, ''), '\s+', '', 'g') <> ''""",
)
def sections(spark, sf):
    return K.split_sections(headed(spark, sf), "doc_id").select("doc_id", "section", "heading", "line_start", "line_end")


@query("kb10_section_chunks")
def section_chunks(spark, sf):
    return K.section_chunks(K.split_sections(headed(spark, sf), "doc_id"), "doc_id")


TREE = "nodes AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent, lang || doc_id AS title FROM documents)"


def tree(spark, sf):
    d = T.load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 3)).alias("parent"), F.concat("lang", F.col("doc_id").cast("string")).alias("title"))


@query("kb11_flatten_tree", f"WITH RECURSIVE {TREE}, w AS (SELECT id, title AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, w.path || '/' || n.title FROM w JOIN nodes n ON n.parent = w.id) SELECT id, path, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = w.id) AS is_leaf FROM w")
def flatten_tree(spark, sf):
    return K.flatten_tree(tree(spark, sf))


def marked(spark, sf):
    """Documents with page and lesson markers of the kinds the chunker reads."""
    k = F.col("doc_id")
    mark = (
        F.when(k % 4 == 0, F.concat(F.lit("<!-- PDF_PAGE_START:"), F.format_string("%04d", k % 900 + 1), F.lit(" -->")))
        .when(k % 4 == 1, F.concat(F.lit("source_page:"), (k % 90).cast("string"), F.lit(" lesson : "), (k % 40).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("page_start:"), (k % 50).cast("string"), F.lit(" page_end:"), (k % 50 + 2).cast("string"))).otherwise("PDF Page 0042")
    )
    title = F.when(k % 5 == 0, F.concat(F.lit("lesson-"), F.format_string("%03d", k % 108), F.lit(" 教你炒股票 1：x"))).otherwise("t")
    return T.load(spark, sf, "documents").select(k.alias("id"), title.alias("title"), F.concat(mark, F.lit("\n"), F.col("text")).alias("raw_text"))


@query(
    "kb12_tree_chunks",
    """WITH n AS (
  SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'source_page:' || doc_id % 90 || ' lesson : ' || doc_id % 40 WHEN 2 THEN 'page_start:' || doc_id % 50 || ' page_end:' || doc_id % 50 + 2 ELSE 'PDF Page 0042' END || chr(10) || text AS raw,
         CASE doc_id % 4 WHEN 0 THEN doc_id % 900 + 1 WHEN 1 THEN doc_id % 90 WHEN 2 THEN doc_id % 50 ELSE 42 END::INTEGER AS page_start,
         CASE doc_id % 4 WHEN 0 THEN doc_id % 900 + 1 WHEN 1 THEN doc_id % 90 WHEN 2 THEN doc_id % 50 + 2 ELSE 42 END::INTEGER AS page_end,
         CASE WHEN doc_id % 5 = 0 THEN doc_id % 108 WHEN doc_id % 4 = 1 THEN doc_id % 40 END::INTEGER AS lesson FROM documents
), t AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS body FROM n),
b AS (SELECT *, CASE WHEN page_start > 0 THEN 'pageindex.' || CASE WHEN lesson > 0 THEN printf('l%03d', lesson) ELSE 'front' END || printf('.p%04d', page_start) || CASE WHEN page_end > 0 AND page_end <> page_start THEN printf('-p%04d', page_end) ELSE '' END
  ELSE printf('pageindex.node%04d', id) END AS base FROM t WHERE length(body) >= 80),
c AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b)
SELECT base || CASE WHEN k > 1 THEN '.' || k ELSE '' END AS chunk_id, id, page_start, page_end, lesson, body AS text FROM c""",
)
def tree_chunks(spark, sf):
    return K.tree_chunks(marked(spark, sf))


@query(
    "kb13_page_markers",
    """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 900 + 1)::VARCHAR WHEN 1 THEN (doc_id % 90)::VARCHAR WHEN 2 THEN (doc_id % 50) || ',' || (doc_id % 50 + 1) || ',' || (doc_id % 50 + 2) ELSE '42' END AS pages,
    CASE WHEN doc_id % 5 = 0 THEN doc_id % 108 WHEN doc_id % 4 = 1 THEN doc_id % 40 END::INTEGER AS lesson FROM documents""",
)
def page_markers(spark, sf):
    x = marked(spark, sf)
    lesson = F.coalesce(X.lesson_of(F.col("title")), X.lesson_of(F.substring("raw_text", 1, 800)))
    return x.select("id", F.array_join(X.page_numbers(F.col("raw_text")), ",").alias("pages"), lesson.alias("lesson"))


def books(spark, sf):
    """Books of 60 pages: a contents page, then document text with dated headings on every fifth page."""
    k = F.col("doc_id")
    d = docs(spark, sf).select(F.floor(k / 60).alias("book"), (k % 60 + 1).cast("int").alias("page"), "text")
    lesson = F.floor(F.col("page") / 5)
    entry = lambda i: F.concat(F.lit(f"教你炒股票 {i}：题目 {i} ... (2006-0{1 + i % 9}-01 10:00) ......{i * 5}"))
    contents = F.concat_ws("\n", *[entry(i) for i in range(1, 9)])
    body = F.when(F.col("page") == 1, contents).when(F.col("page") % 5 == 0, F.concat(F.lit("教你炒股票 "), lesson.cast("string"), F.lit("：正文 (2006-01-01 10:00)\n"), F.col("text"))).otherwise(F.col("text"))
    return d.withColumn("text", body)


@query(
    "kb14_toc",
    """WITH p AS (SELECT doc_id // 60 AS book, (doc_id % 60 + 1)::INTEGER AS page FROM documents),
l AS (SELECT unnest(range(1, 9))::INTEGER AS i),
front AS (SELECT book, i AS lesson, '题目 ' || i AS title, '2006-0' || 1 + i % 9 || '-01 10:00' AS date, i * 5 AS toc_page FROM p, l WHERE page = 1),
heads AS (SELECT book, page // 5 AS lesson, '正文' AS title, '2006-01-01 10:00' AS date, page AS toc_page FROM p WHERE page % 5 = 0)
SELECT book::BIGINT AS book, lesson::INTEGER AS lesson, title, date, toc_page::INTEGER AS toc_page FROM front
UNION ALL SELECT h.book::BIGINT, h.lesson::INTEGER, h.title, h.date, h.toc_page::INTEGER FROM heads h WHERE NOT EXISTS (SELECT 1 FROM front f WHERE f.book = h.book AND f.lesson = h.lesson)""",
)
def toc(spark, sf):
    p = books(spark, sf)
    return K.toc_from_headings(p, K.toc_rows(p))


@query("kb15_heading_offsets")
def heading_offsets(spark, sf):
    p = books(spark, sf)
    t = K.toc_from_headings(p, K.toc_rows(p))
    pos = (F.col("page") * 100000).cast("int")
    h = p.select("book", "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"教你炒股票\s*(\d{1,3})\s*[：:]?"), F.lit(1))).alias("i", "l"))
    heads = h.select("book", F.col("l").cast("int").alias("lesson"), "page", (pos + F.col("i")).cast("int").alias("pos"))
    return K.heading_offsets(heads, t, p.select("book", "page", pos.alias("pos")))


KG = CONCEPTS + """, dc AS (SELECT doc_id, doc_id % 50 + 1 AS page, title, list(DISTINCT concept) AS concepts FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents) JOIN concepts ON contains(text, keyword) GROUP BY 1, 2, 3),
cp AS (SELECT DISTINCT concept, length(keyword) AS page FROM concepts)
"""


def graph_inputs(spark, sf):
    d = docs(spark, sf)
    hit = K.concepts_in(d, concepts(spark, sf), "doc_id")
    ch = d.join(hit, "doc_id").select(F.col("doc_id").cast("string").alias("chunk_id"), "title", (F.col("doc_id") % 50 + 1).alias("page"), "concepts")
    cp = concepts(spark, sf).select("concept", F.length("keyword").alias("page")).distinct()
    return cp, ch


@query("kb16_graph_edges", "WITH " + KG + " SELECT 'concept:' || concept AS \"from\", 'source_page:' || page AS \"to\", 'anchored_to' AS type FROM cp UNION SELECT 'chunk:' || doc_id, 'concept:' || unnest(concepts), 'mentions' FROM dc UNION SELECT 'chunk:' || doc_id, 'source_page:' || page, 'from_page' FROM dc")
def graph_edges(spark, sf):
    return K.graph(*graph_inputs(spark, sf))[1]


@query("kb16_set03_graph_nodes", "WITH " + KG + " SELECT DISTINCT 'concept:' || concept AS id, 'concept' AS type, concept AS label FROM cp UNION SELECT 'source_page:' || page, 'source_page', 'p' || page FROM cp UNION SELECT 'chunk:' || doc_id, 'chunk', title FROM dc")
def graph_nodes(spark, sf):
    return K.graph(*graph_inputs(spark, sf))[0]


@query(
    "kb17_manifest",
    "WITH " + KG + ", m AS (SELECT doc_id::VARCHAR AS cid, unnest(concepts) AS concept FROM dc) SELECT c.concept, count(m.cid) AS chunk_count, coalesce(array_to_string(list(m.cid ORDER BY m.cid) FILTER (m.cid IS NOT NULL)[1:200], ','), '') AS chunks, count(m.cid) > 200 AS chunks_truncated FROM (SELECT DISTINCT concept FROM cp) c LEFT JOIN m USING (concept) GROUP BY c.concept",
)
def manifest(spark, sf):
    cp, ch = graph_inputs(spark, sf)
    return K.manifest(ch, cp).withColumn("chunks", F.array_join("chunks", ","))


@query("kb18_inventory")
def inventory(spark, sf):
    return K.inventory(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "type", "role", "sha256", "size")


@query("kb19_integrity", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'size mismatch' WHEN doc_id % 7 = 2 THEN 'sha256 mismatch' END AS problem FROM documents WHERE doc_id % 7 <= 2")
def integrity(spark, sf):
    k = F.col("doc_id")
    d = T.load(spark, sf, "documents").select(k.cast("string").alias("path"), k.alias("k"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("size"))
    expected = d.select("path", "sha256", "size")
    actual = d.filter(F.col("k") % 7 != 0).select("path", F.when(F.col("k") % 7 == 2, "x").otherwise(F.col("sha256")).alias("sha256"), (F.col("size") + F.when(F.col("k") % 7 == 1, 1).otherwise(0)).alias("size"))
    return K.integrity_errors(expected, actual)


@query("kb19_concept_contract", "WITH f AS (SELECT unnest(['" + "', '".join(K.CONTRACT) + "']) AS field, unnest(range(7)) AS i), n AS (SELECT 'n' || n_nationkey AS concept, n_nationkey AS k FROM nation) SELECT concept, field AS problem FROM n, f WHERE i >= k % 8 UNION ALL SELECT concept, 'chunks' FROM n WHERE k % 3 = 0 UNION ALL SELECT concept, 'source_pages' FROM n WHERE k % 4 = 0")
def concept_contract(spark, sf):
    k = F.col("n_nationkey")
    full = F.array(*[F.lit(f) for f in K.CONTRACT])
    x = T.load(spark, sf, "nation").select(
        F.concat(F.lit("n"), k.cast("string")).alias("concept"), F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(k)).alias("source_pages"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("chunks"), F.slice(full, F.lit(1), k % 8).alias("contract"),
    )
    return K.concept_errors(x)


@query("kb20_coverage", "WITH " + KG + ", e AS (SELECT 'concept:' || concept AS a, 'source_page:' || page AS b, 1 AS t FROM cp UNION SELECT 'chunk:' || doc_id, 'concept:' || unnest(concepts), 2 FROM dc UNION SELECT 'chunk:' || doc_id, 'source_page:' || page, 3 FROM dc), n AS (SELECT 'concept:' || concept AS id FROM cp UNION SELECT 'source_page:' || page FROM cp UNION SELECT 'chunk:' || doc_id FROM dc) SELECT (SELECT count(*) FROM dc) AS chunks, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT concept) FROM cp) AS concepts, 0::BIGINT AS errors, CASE WHEN (SELECT count(*) FROM dc) < 100 THEN 'thin_coverage' ELSE 'none' END AS risks")
def coverage(spark, sf):
    cp, ch = graph_inputs(spark, sf)
    nodes, edges = K.graph(cp, ch)
    none = K.integrity_errors(*[ch.select(F.col("chunk_id").alias("path"), F.lit("h").alias("sha256"), F.lit(1).alias("size"))] * 2)
    return K.coverage(ch, nodes, edges, cp.select("concept").distinct(), none)


@query("kb20_boundary", "SELECT 'n' || n_nationkey AS concept, n_nationkey % 3 <> 0 AS has_boundary, n_nationkey % 3 = 1 AS has_phrase FROM nation")
def boundary(spark, sf):
    k = F.col("n_nationkey")
    x = T.load(spark, sf, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("concept"), F.when(k % 3 == 1, "Qualitative use only").when(k % 3 == 2, "other").alias("boundary"))
    return K.boundary_check(x)


@query(
    "kb21_retrieval_eval",
    S + ", ex AS (SELECT item_id AS qid, (SELECT coalesce(list(doc_id ORDER BY doc_id), []) FROM documents WHERE contains(documents.text, b.text)) AS expected FROM benchmark b) SELECT ex.qid, len(expected) = 0 OR coalesce(bool_or(rank = 1 AND list_contains(expected, doc_id)), false) AS top1_ok, len(expected) = 0 OR coalesce(bool_or(rank <= 2 AND list_contains(expected, doc_id)), false) AS passed FROM ex LEFT JOIN top ON top.qid = ex.qid GROUP BY ex.qid, expected",
)
def retrieval_eval(spark, sf):
    d = docs(spark, sf)
    b = T.load(spark, sf, "benchmark")
    hit = find_patterns(d, b.select("text"), "doc_id").select("doc_id", "pattern")
    expected = b.select(F.col("item_id").alias("qid"), F.col("text").alias("pattern")).join(hit, "pattern", "left").groupBy("qid").agg(F.sort_array(F.collect_list("doc_id")).alias("expected"))
    return K.retrieval_eval(K.search(d, kb_queries(spark, sf)), expected)


@query("kb23_card_stats", "SELECT role AS school, count(*) AS cards, count(DISTINCT conv_id) AS convs, round(avg(length(text)), 4) AS mean_len FROM conversations GROUP BY role")
def card_stats(spark, sf):
    c = T.load(spark, sf, "conversations")
    nested = c.select("conv_id", F.array(F.struct("role", "text")).alias("source_cards"))
    x = nested.select("conv_id", F.explode("source_cards").alias("s"))
    return x.groupBy(F.col("s.role").alias("school")).agg(F.count("*").alias("cards"), F.count_distinct("conv_id").alias("convs"), r(F.avg(F.length("s.text")), 4, "mean_len"))
