"""Normalisers over landed raw vendor files. Each takes raw rows and returns bars or quotes with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_CSV = "time_key string, open double, high double, low double, close double, volume double, turnover double, turnover_rate double, _corrupt string"


def parse_time(col: Column | str) -> Column:
    """Times of length 10, 17 or 19."""
    x = F.col(col) if isinstance(col, str) else col
    n = F.length(x)
    milli = F.concat(F.substring(x, 1, 14))
    return (
        F.when(n == 10, F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))
        .when(n == 17, F.try_to_timestamp(milli, F.lit("yyyyMMddHHmmss")))
        .when(n == 19, F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")))
    )


def parse_date_any(col: Column | str) -> Column:
    """Dates written 2021-09-13, 20210913 or as a longer string that starts with 2021-09-13."""
    x = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(
        F.when(F.length(x) == 8, F.to_date(F.try_to_timestamp(x, F.lit("yyyyMMdd")))),
        F.to_date(F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd"))),
    )


def to_float(col: Column | str) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def read_bar_csv(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Header CSV of bars; rows with a wrong number of columns fail loudly, the time range is filtered at the scan."""
    df = spark.read.schema(BAR_CSV).option("header", True).option("mode", "FAILFAST").csv(path).drop("_corrupt")
    df = df.withColumn("ts", parse_time("time_key"))
    if begin:
        df = df.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
    if end:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df.drop("time_key")


def _csv_rows(lines: DataFrame) -> DataFrame:
    schema = "time_key string, open double, high double, low double, close double, volume double, bad string"
    row = F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    df = lines.select("symbol", "value", row.alias("r")).select("symbol", "value", "r.*").withColumn("ts", parse_time("time_key"))
    return df.withColumn("problem", F.when(F.col("bad").isNotNull() | F.col("value").isNull(), "malformed").when(F.col("ts").isNull(), "no time"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(symbol, value, problem) of the lines that are no bars, for a side output and its count."""
    return _csv_rows(lines).filter("problem IS NOT NULL").select("symbol", "value", "problem")


def csv_lines(lines: DataFrame, begin: str | None = None, end: str | None = None, strict: bool = True) -> DataFrame:
    """(symbol, value) text lines of bar CSV to bars. A line that is no bar fails the query; with strict=False such lines
    are left to `rejected_lines`."""
    df = _csv_rows(lines)
    if strict:
        broken = F.raise_error(F.concat(F.col("problem"), F.lit(" line: "), F.coalesce("value", F.lit("null"))))
        df = df.withColumn("ts", F.when(F.col("problem").isNull(), F.col("ts")).otherwise(broken.cast("timestamp")))
    df = df.filter("problem IS NULL" if not strict else "ts IS NOT NULL").drop("time_key", "bad", "value", "problem")
    if begin:
        df = df.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
    if end:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def json_arrays(raw: DataFrame) -> DataFrame:
    """(symbol, value) with {"qfqday" or "day": [[date, open, close, high, low, volume], ...]}."""
    rows = F.from_json("value", "struct<qfqday:array<array<string>>,day:array<array<string>>>")
    x = raw.select("symbol", rows.alias("j")).select("symbol", F.explode(F.coalesce("j.qfqday", "j.day")).alias("a"))
    num = lambda i: F.get("a", F.lit(i)).try_cast("double")
    return x.select(
        "symbol", F.to_date(F.try_to_timestamp(F.col("a")[0], F.lit("yyyy-MM-dd"))).alias("day"), num(1).alias("open"),
        num(2).alias("close"), num(3).alias("high"), num(4).alias("low"), F.coalesce(num(5), F.lit(1.0)).alias("volume"),
    )


# Column names of the localised bar tables.
LOCAL_NAMES = {"日期": "day", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "turnover", "换手率": "turnover_rate"}


def localised(df: DataFrame) -> DataFrame:
    """Bars with localised headers and any of three date encodings; missing turnover columns become 0 or null."""
    x = df.withColumnsRenamed(LOCAL_NAMES)
    if "turnover" not in x.columns:
        x = x.withColumn("turnover", F.lit(0.0))
    nums = [c for c in ("open", "high", "low", "close", "volume", "turnover", "turnover_rate") if c in x.columns]
    return x.withColumns({"day": parse_date_any("day"), **{c: to_float(c) for c in nums}})


def is_index(code: Column) -> Column:
    return code.rlike(r"^s[hz](000|399)")


def row_arrays(df: DataFrame) -> DataFrame:
    """(symbol, row array<string>) = date, open, high, low, close, volume, amount, turn."""
    num = lambda i: to_float(F.get("row", F.lit(i)))
    return df.select(
        "symbol", F.to_date(F.try_to_timestamp(F.col("row")[0], F.lit("yyyy-MM-dd"))).alias("day"), num(1).alias("open"), num(2).alias("high"),
        num(3).alias("low"), num(4).alias("close"), num(5).alias("volume"), num(6).alias("turnover"), num(7).alias("turnover_rate"),
    )


def epoch_arrays(df: DataFrame) -> DataFrame:
    """(symbol, row array<double>) = epoch milliseconds, open, high, low, close, volume."""
    at = lambda i: F.get("row", F.lit(i))
    return df.select("symbol", F.timestamp_millis(at(0).cast("bigint")).alias("ts"), at(1).alias("open"), at(2).alias("high"),
                     at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"))


def minute_json(raw: DataFrame) -> DataFrame:
    """(symbol, value) with [{"day", "time", "close", "volume"}, ...] of 5-minute bars."""
    rows = F.from_json("value", "array<struct<day:string,time:string,close:string,volume:string>>")
    return raw.select("symbol", F.inline(rows)).select(
        "symbol", F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).alias("day"), "time", to_float("close").alias("close"), to_float("volume").alias("volume"),
    )


def quote_lines(lines: DataFrame) -> DataFrame:
    """`~`-separated quote lines: name p[1], code p[2], price p[3], change p[32]; at least 40 fields, price above 0."""
    p = F.split("value", "~")
    x = lines.select(p.alias("p")).filter(F.size("p") >= 40)
    x = x.select(F.col("p")[2].alias("symbol"), F.col("p")[1].alias("name"), F.col("p")[3].try_cast("double").alias("price"), F.col("p")[32].try_cast("double").alias("change_pct"))
    return x.filter((F.col("price") > 0) & F.col("change_pct").isNotNull())


# Name parts and code prefixes that are left out of the main-market universe.
SKIP_NAMES = ("ST", "退")
SKIP_PREFIXES = ("688", "8", "4", "83", "87", "200", "900", "920")


def main_market(df: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    bad = F.lit(False)
    for part in SKIP_NAMES:
        bad = bad | F.contains(F.col(name), F.lit(part))
    return df.filter(~bad & ~F.col(code).rlike("^(" + "|".join(SKIP_PREFIXES) + ")"))


def tradable(df: DataFrame) -> DataFrame:
    return main_market(df).filter((F.col("volume") > 0) & (F.col("price") > 0)).select("code", "name", "price", "change_pct")


def padded(code: Column, width: int = 6) -> Column:
    return F.lpad(code.cast("string"), width, "0")


def vendor_symbol(code: Column, vendor: str) -> Column:
    """Vendor spelling of a code: suffix or prefix by first digit, four digits for the second market."""
    six = F.startswith(code, F.lit("6"))
    second = F.startswith(code, F.lit("hk"))
    four = F.lpad(F.regexp_replace(code, "^hk0*", ""), 4, "0")
    if vendor == "suffix":
        return F.when(second, F.concat(four, F.lit(".HK"))).otherwise(F.concat(code, F.when(six, ".SS").otherwise(".SZ")))
    if vendor == "dotted":
        return F.when(second, F.concat(F.lit("hk."), F.regexp_replace(code, "^hk", ""))).otherwise(F.concat(F.when(six, "sh.").otherwise("sz."), code))
    if vendor == "prefix":
        return F.when(second, code).otherwise(F.concat(F.when(six, "sh").otherwise("sz"), code))
    raise ValueError(f"unknown vendor form {vendor}")


def exploded_themes(df: DataFrame) -> DataFrame:
    return df.withColumn("theme", F.explode(F.split("themes", r"\|"))).drop("themes")


def strip_bom(df: DataFrame) -> DataFrame:
    """Drop a byte-order mark from the first header."""
    return df.toDF(*[c.replace("﻿", "") for c in df.columns])


# Localised headers of board tables.
BOARD_NAMES = {"板块名称": "name", "涨跌幅": "chg", "上涨家数": "up", "下跌家数": "dn", "总市值": "value"}


def boards(df: DataFrame) -> DataFrame:
    x = strip_bom(df).withColumnsRenamed(BOARD_NAMES)
    return x.select("name", to_float("chg").alias("chg"), F.coalesce(F.col("up").try_cast("int"), F.lit(0)).alias("up"),
                    F.coalesce(F.col("dn").try_cast("int"), F.lit(0)).alias("dn"), to_float("value").alias("value"))


def board_flow_json(raw: DataFrame) -> DataFrame:
    """Nested fund flow: net in 10k, amount in 100m."""
    item = "array<struct<name:string,zdf:string,zljlr:string,cje:string>>"
    j = F.from_json("value", f"struct<data:struct<fundflow:struct<plate:struct<top:{item}>,concept:struct<top:{item}>>>>")
    both = raw.select(j.alias("j")).select("j.data.fundflow.*")
    rows = both.select(F.explode(F.concat(F.coalesce("plate.top", F.array().cast(item)), F.coalesce("concept.top", F.array().cast(item)))).alias("i"))
    return rows.select(F.col("i.name").alias("name"), F.col("i.zdf").try_cast("double").alias("pct"), (F.col("i.zljlr").try_cast("double") / 10000).alias("net_10k"),
                       (F.col("i.cje").try_cast("double") / 100000000).alias("amount_100m"))


def board_ranking(df: DataFrame, top: int = 10) -> DataFrame:
    """Boards by change per kind with amounts in 100 millions; `top` rows per kind are the report."""
    w = Window.partitionBy("kind").orderBy(F.desc("change_pct"), "name")
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).select(
        "kind", "rn", "name", "change_pct", (F.col("amount") / 1e8).alias("amount_100m"), (F.col("main_net_amount") / 1e8).alias("net_100m"), "up_count", (F.col("up_count") + F.col("down_count")).alias("total"),
    )


def landed_frame(df: DataFrame, min_bars: int = 30) -> DataFrame:
    """Capitalised OHLCV frames of one vendor, series with at least `min_bars` rows."""
    from barflow.operators.bars import long_enough

    names = {"Date": "day", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    return long_enough(df.withColumnsRenamed(names), min_bars)


def table_kind(first_header: Column) -> Column:
    """Which of three pasted tables a header row belongs to."""
    return (
        F.when(F.contains(first_header, F.lit("沽空")), "short_selling").when(F.contains(first_header, F.lit("牛/熊")), "callable")
        .when(F.contains(first_header, F.lit("购/沽")), "warrant").otherwise("unknown")
    )


# Columns of the pasted tables.
TSV_SCHEMAS = {
    "short_selling": "day string, price double, chg double, chg_pct double, short_shares double, short_amount double, turnover double, market_share double, short_ratio double, mean3 double, mean5 double",
    "warrant": "hot string, name string, code string, kind string, underlying string, issuer string, price double, chg double, chg_pct double, turnover double, premium double, moneyness double, leverage double, implied_vol double, strike double, outstanding_pct double, outstanding double, last_day string",
    "callable": "hot string, name string, code string, kind string, underlying string, issuer string, price double, chg double, chg_pct double, turnover double, premium double, strike double, recall double, leverage double, ratio double, outstanding_pct double, outstanding double, last_day string",
}


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Read a pasted table; its first line decides the schema."""
    header = spark.read.text(path).limit(1)
    kind = header.select(table_kind(F.col("value"))).first()[0]
    if kind not in TSV_SCHEMAS:
        raise ValueError(f"unknown table in {path}")
    return spark.read.schema(TSV_SCHEMAS[kind]).option("sep", "\t").option("header", True).csv(path)


def tsv_lines(lines: DataFrame, kind: str) -> DataFrame:
    return lines.select(F.from_csv("value", F.lit(TSV_SCHEMAS[kind]), {"sep": "\t"}).alias("r")).select("r.*")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Directory of nested JSON cards without the index file; unreadable files are skipped."""
    schema = (
        "card_id string, canonical_term string, aliases array<string>, school string, definition string, identification_rules array<string>, "
        "trading_implication string, common_mistakes array<string>, source_cards array<struct<video_id:string,segment_ids:array<string>,time_range:array<double>,extraction_confidence:double>>, "
        "stats map<string,string>, _bad string"
    )
    df = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    df = df.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return df.filter((F.col("file") != "index") & F.col("_bad").isNull()).drop("_bad")


def read_chunks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSONL chunk file; strict mode stops at the first broken line."""
    schema = (
        "chunk_id string, kind string, source string, path string, title string, page_start int, page_end int, lesson int, "
        "lesson_title string, concepts array<string>, keywords array<string>, text string"
    )
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


# ---- JSON without a schema ------------------------------------------------------------------------------------


def json_leaves(text: Column) -> Column:
    """The scalar values of a JSON text in their order, as strings; keys and nulls are left out.

    A string is a value unless a colon follows it, and strings are taken whole, so marks inside them do not count. The inside of
    a string is matched possessively: a plain repeated choice recurses once per character and overflows the stack on long texts."""
    token = r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?|-?[0-9][0-9.eE+\-]*|true|false|null'
    tokens = F.filter(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda t: ~t.endswith(":") & (t != "null"))
    # booleans are spelled as the record text has them
    spelled = F.transform(tokens, lambda t: F.when(t == "true", '"True"').when(t == "false", '"False"').otherwise(t))
    quoted = F.transform(spelled, lambda t: F.when(t.startswith('"'), t).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))
    return F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")


def record_text(text: Column) -> Column:
    """All values of a nested JSON record as one squeezed string."""
    return F.trim(F.regexp_replace(F.array_join(json_leaves(text), " "), r"\s+", " "))


def read_json_files(spark: SparkSession, path: str, skip: tuple[str, ...] = ("index",)) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable): one JSON object per file, as (file, v, text) with v a variant, whatever its fields; and the files
    that hold no JSON object, with their size. Files named in `skip` are in neither."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    x = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))
    x = x.filter(~F.col("file").isin(*skip)).withColumn("v", F.try_parse_json("text"))
    whole = F.col("v").isNotNull() & F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return x.filter(whole).select("file", "v", "text"), x.filter(~whole).select("file", "size")


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken): objects of JSON lines as (file, line, v, text), lines counted from 1 over the whole file, blank lines
    left out; and the lines that hold none. Files are read in splits; counts per split give the numbers their offsets."""
    m = F.col("_metadata")
    raw = spark.read.text(path).select(m["file_name"].alias("file"), m["file_block_start"].alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = raw.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("file", "block").orderBy("at")
    x = raw.withColumn("k", F.row_number().over(inner)).join(offsets, ["file", "block"])
    x = x.select("file", (F.col("offset") + F.col("k")).alias("line"), F.trim("text").alias("text")).filter("text <> ''").withColumn("v", F.try_parse_json("text"))
    whole = F.col("v").isNotNull() & F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return x.filter(whole).select("file", "line", "v", "text"), x.filter(~whole).select("file", "line", "text")
