import pytest
from pyspark.sql import functions as F

from barflow.functions import text as X
from barflow.operators.joins import asof_last, find_patterns
from barflow.plans import knowledge as K


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_terms_of_latin_and_han_text(spark):
    got = set(one(spark, "Buy points 三类买点 MACD", X.terms("t", 3)))
    assert {"buy", "points", "point", "macd", "三类买点", "三类", "类买", "买点", "三类买", "类买点"} == got
    assert one(spark, "buys", X.terms("t", 4)) == ["buys"]
    assert set(one(spark, "buys", X.terms("t", 3))) == {"buys", "buy"}
    assert X.by_length is not None and one(spark, "bb aaa cc", X.by_length(X.terms("t"))) == ["aaa", "bb", "cc"]


def test_slug_and_squeeze(spark):
    assert one(spark, " A b/c 中枢! ", X.slug(F.col("t"))) == "a-b-c-中枢"
    assert one(spark, "!!", X.slug(F.col("t"))) == "chunk"
    assert one(spark, " a \n b ", X.squeeze("t")) == "a b"


def test_windows_cut_and_cover():
    text = ("x" * 700 + "。") + "y" * 800 + "\n" + "z" * 300
    w = X.cut_windows(text)
    assert w[0][:2] == (0, 701) and w[1][0] == 701 - 120
    assert w[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(w, w[1:]))
    assert X.cut_windows("  short ") == [(0, 5, "short")]


def test_find_patterns_equals_a_plain_search(spark):
    """Patterns inside words, across words, at their edges, of blanks only, overlapping themselves, and absent ones."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    texts = ["".join(word() + r.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " ", "\x1c\x85\u3000wide\u2003blank", "aaaa aaaa", "ab" * 5000 + " " + "c" * 4000, "the cat", "a dog and a cat", "é中枢 中枢买点é"]
    patterns = [t[i : i + n] for t in texts if t for n in (1, 2, 3, 5, 9, 25) for i in [r.randrange(max(1, len(t) - n))]]
    patterns += ["cat", "a ", "dog and", "absent", "aa", "  ", " ", "", "bb\tbb nothere cc", "中枢", "枢 中", "é", None, "cat "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = find_patterns(docs, spark.createDataFrame([(p,) for p in patterns], "p string"), "id").collect()
    want = {(i, p, t.count(p)) for i, t in enumerate(texts) if t for p in set(patterns) if p and p in t}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 500
    assert find_patterns(docs, spark.createDataFrame([], "p string"), "id").count() == 0
    assert find_patterns(docs.limit(0), spark.createDataFrame([("a",)], "p string"), "id").count() == 0


def test_a_million_patterns_in_slices(spark):
    """Patterns are joined in bounded slices, and matches do not depend on how many slices and shards there are."""
    docs = spark.range(200).select(F.col("id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x"), (F.col("id") * 7).cast("string")).alias("text"))
    many = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x"), (F.col("id") * 7).cast("string")).alias("p"))
    got = {(r.id, r.pattern, r.n) for r in find_patterns(docs, many, "id").collect()}
    # "w1 x7" lies in "w1 x7" only, "w1 x7" followed by a digit in longer ones
    assert got >= {(i, f"w{i} x{7 * i}", 1) for i in range(200)}
    few = many.limit(300)
    want = sorted(map(tuple, find_patterns(docs, few, "id").collect()))
    assert want and sorted(map(tuple, find_patterns(docs, few, "id", slice_=40, shard=500).collect())) == want


def test_asof(spark):
    l = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "page int")
    r = spark.createDataFrame([(5, 1), (17, 2), (40, 3)], "page int, lesson int")
    got = {x.page: x.lesson for x in asof_last(l, r, "page", "lesson", width=8).collect()}
    assert got == {p: next((v for k, v in ((40, 3), (17, 2), (5, 1)) if p >= k), None) for p in got}


def test_snippet(spark):
    text = "a" * 100 + " Needle " + "b" * 300
    got = one(spark, text, X.snippet(F.col("t"), F.lit("needle"), F.array().cast("array<string>")))
    assert got.startswith("...") and got.endswith("...") and "Needle" in got


def test_pages_and_sections(spark):
    df = spark.createDataFrame([(1, " one \f\f two "), (2, "intro\n# A\nx\n### B \ny\n#### deep\nz")], "id int, text string")
    pages = [(r.page, r.text) for r in K.split_pages(df.filter("id = 1"), "id").orderBy("page").collect()]
    assert pages == [(1, "one"), (3, "two")]
    s = [(r.heading, r.line_start, r.line_end) for r in K.split_sections(df.filter("id = 2"), "id").orderBy("line_start").collect()]
    assert s == [("A", 2, 3), ("B", 4, 7)]
    plain = K.split_sections(spark.createDataFrame([(9, "no\nheads")], "id int, text string"), "id").first()
    assert plain.heading is None and (plain.line_start, plain.line_end) == (1, 2)


def test_page_markers(spark):
    f = lambda t: one(spark, t, X.page_numbers(F.col("t")))
    assert f("PDF_PAGE_START:0007 x source_page:9") == [7, 9]
    assert f("page_start:3 page_end:5") == [3, 4, 5]
    assert f("pdf page 0042") == [42] and f("none") == []
    assert one(spark, "lesson-012 教你炒股票 12：题", X.lesson_of(F.col("t"))) == 12


def test_toc_and_headings(spark):
    pages = spark.createDataFrame(
        [(1, 1, "教你炒股票 1：甲 (2006-06-07 18:08) .....8\n教你炒股票 2：乙 (2006-06-08) ... 20"), (1, 9, "教你炒股票 1：甲 正文"), (1, 21, "教你炒股票 2：乙 正文"), (1, 30, "教你炒股票 3：丙 (2006-07-01) 正文")],
        "book int, page int, text string",
    )
    toc = K.toc_rows(pages)
    assert [(r.lesson, r.title, r.toc_page) for r in toc.orderBy("lesson").collect()] == [(1, "甲", 8), (2, "乙", 20)]
    full = K.toc_from_headings(pages, toc)
    assert [(r.lesson, r.toc_page) for r in full.orderBy("lesson").collect()] == [(1, 8), (2, 20), (3, 30)]
    heads = spark.createDataFrame([(1, 1, 9, 900), (1, 2, 8, 850), (1, 2, 21, 2100), (1, 3, 60, 6000)], "book int, lesson int, page int, pos int")
    starts = spark.createDataFrame([(1, 8, 800), (1, 20, 2000), (1, 30, 3000)], "book int, page int, pos int")
    got = [(r.lesson, r.pos) for r in K.heading_offsets(heads, full, starts).orderBy("lesson").collect()]
    assert got == [(1, 900), (2, 2100), (3, 3000)]  # the far heading of lesson 3 loses to its page start


def test_tree_chunks_get_unique_ids(spark):
    body = "x" * 90
    n = spark.createDataFrame([(1, "lesson-005 教你炒股票 5：t", f"PDF_PAGE_START:0012 {body}"), (2, "lesson-005 教你炒股票 5：t", f"PDF_PAGE_START:0012 {body}"), (3, "t", "short"), (4, "t", body)], "id int, title string, raw_text string")
    assert [r.chunk_id for r in K.tree_chunks(n).orderBy("id").collect()] == ["pageindex.l005.p0012", "pageindex.l005.p0012.2", "pageindex.node0004"]


def test_search_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "zone divergence", "zone zone zone divergence"), (2, "other", "a zone here"), (3, "none", "nothing")], "doc_id int, title string, text string")
    q = spark.createDataFrame([(7, "zone divergence")], "qid int, query string")
    got = {r.doc_id: r.score for r in K.scores(docs, q).collect()}
    phrase = 80 + 15
    assert got == {1: pytest.approx(phrase + 3 * 6 * 2.5 + 10 * 2.5), 2: pytest.approx(6.0)}
    assert [r.doc_id for r in K.search(docs, q, 1).collect()] == [1]


def test_exact_card_wins(spark):
    cards = spark.createDataFrame([("Spring", "a spring test"), ("other", "spring again")], "key string, text string")
    q = spark.createDataFrame([(1, "spring"), (2, "again")], "qid int, query string")
    got = {(r.qid, r.key, r.exact) for r in K.card_search(cards, q).collect()}
    assert got == {(1, "Spring", True), (2, "other", False)}


def test_errors_and_contract(spark):
    c = spark.createDataFrame([("a", [1], ["c"], K.CONTRACT), ("b", [], ["c"], K.CONTRACT[:-1])], "concept string, source_pages array<int>, chunks array<string>, contract array<string>")
    assert {(r.concept, r.problem) for r in K.concept_errors(c).collect()} == {("b", "source_pages"), ("b", K.CONTRACT[-1])}
