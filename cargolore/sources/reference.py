"""Readers of reference data, shipments, and evaluation files.

Each gives one DataFrame in the library's own columns.  Headers are found by
alias, without regard to case; the first alias that a file has wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolore.functions.codes import digits, level_codes, six_digits, split_codes

# Header names of the files.
CODE_HEADERS = ("hscode", "hs_code", "code", "commodity", "schedule b", "schedule_b", "number")
TEXT_HEADERS = ("description (en)", "description", "description_en", "long description", "text")
SECOND_HEADERS = ("description (fr)", "description_fr")
KEYWORD_HEADERS = ("keywords", "keyword", "phrase", "phrases")
MAX_TEXT, MAX_KEYWORD_LEN = 2000, 2000


def find(df: DataFrame, names: tuple[str, ...], required: bool = True) -> Column | None:
    """The first column called one of ``names``; byte order marks are ignored.
    If there must be one and is not, this raises."""
    have = {c.replace("﻿", "").strip().lower(): c for c in reversed(df.columns)}
    for n in names:
        if n in have:
            return F.col(f"`{have[n]}`")
    if required:
        raise ValueError(f"none of {names} among {df.columns}")
    return None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_hts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of tariff lines, or one under ``results``; in file order."""
    raw = spark.read.option("multiLine", True).json(path)
    if "results" in raw.columns:
        raw = raw.select(F.posexplode("results").alias("ordinal", "r")).select("ordinal", "r.*")
    else:
        raw = raw.withColumn("ordinal", F.monotonically_increasing_id())
    notes = F.col("notes") if "notes" in raw.columns else F.lit(None).cast("string")
    return raw.select("ordinal", digits("htsno").alias("hs_code"), "description", F.coalesce(F.col("indent").cast("int"), F.lit(0)).alias("indent"), notes.alias("notes"))


def read_schedule_b(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples from a schedule; codes of six digits at least."""
    raw = read_csv(spark, path)
    out = raw.select(F.lit("schedule_b").alias("source"), digits(find(raw, CODE_HEADERS)).alias("source_id"), six_digits(find(raw, CODE_HEADERS)).alias("hs_code"), F.trim(find(raw, TEXT_HEADERS)).alias("description"))
    return out.where("hs_code IS NOT NULL AND description <> ''")


def read_wco(sheets: list[DataFrame]) -> DataFrame:
    """S3: codes with titles and both languages' descriptions, from the first
    sheet, or from all if the first has no usable row.

    Sheets are DataFrames (read workbooks with ``pandas.read_excel`` and
    ``createDataFrame``; Spark has no reader of them)."""

    def one(raw: DataFrame) -> DataFrame:
        second = find(raw, SECOND_HEADERS, required=False)
        text = F.concat_ws(" ", F.trim(find(raw, TEXT_HEADERS)), F.trim(second) if second is not None else F.lit(None))
        out = raw.select(digits(find(raw, CODE_HEADERS)).alias("hs_code"), F.trim(find(raw, TEXT_HEADERS)).alias("title"), text.alias("description"))
        return out.where(F.length("hs_code").isin(2, 4, 6) & (F.col("description") != ""))

    usable = []
    for sheet in sheets:
        try:
            usable.append(one(sheet))
        except ValueError:
            continue
        if len(usable) == 1 and sheet is sheets[0] and not usable[0].isEmpty():
            return usable[0]
    if not usable:
        raise ValueError("no sheet has a code and a description")
    out = usable[0]
    for more in usable[1:]:
        out = out.unionByName(more)
    return out


# What headings of the goods text and of the classification hold.
GOODS_HEADINGS = ("merchandise", "product", "goods", "description of")
CODE_HEADINGS = ("classification", "classified under", "classifiable")


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def _section(html: Column, keywords: tuple[str, ...]) -> Column:
    """the text after the first heading that holds a keyword and has any.

    After ``h1`` to ``h4`` that is all up to the next of these.  After ``strong`` or
    ``b`` it is what elements follow: up to the next heading if a block follows it,
    else up to the end of the block it is in."""
    held = "(?i)(?:" + "|".join(keywords) + ")"

    def heading(section: Column) -> Column:
        return F.when(_plain(F.regexp_extract(section, r"(?is)^<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>", 1)).rlike(held), _plain(F.regexp_replace(section, r"(?is)^<h[1-4]\b[^>]*>.*?</h[1-4]\s*>", " ")))

    def bold(piece: Column) -> Column:
        rest = F.regexp_replace(piece, r"(?is)^<(?:strong|b)\b[^>]*>.*?</(?:strong|b)\s*>", "")
        inner = F.when(rest.rlike(r"(?is)^\s*<(?:p|div|ul|ol|table|blockquote|section)\b"), rest).otherwise(F.split(rest, r"(?i)</(?:p|div|li|td|body)\b", 2)[0])
        texts = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<(\w+)\b[^>]*>(.*?)</\1\s*>"), 2), _plain)
        return F.when(_plain(F.regexp_extract(piece, r"(?is)^<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)\s*>", 1)).rlike(held), F.array_join(F.filter(texts, lambda t: t != ""), " "))

    def of_section(section: Column) -> Column:
        return F.concat(F.array(heading(section)), F.transform(F.split(section, r"(?i)(?=<(?:strong|b)\b)"), bold))

    found = F.flatten(F.transform(F.split(html, r"(?i)(?=<h[1-4]\b)"), of_section))
    return F.get(F.filter(found, lambda t: F.coalesce(t != "", F.lit(False))), F.lit(0))


def read_rulings(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` as labelled examples: the goods
    text, and the code that a page names most often (the first on ties; those of its
    classification section count once more and come first).  The id is looked for in
    the title and then in the first 500 characters.  Pages without a goods text or
    without a code are left out."""
    # few bytes and much work: not to be read in the few tasks that a small file gives
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), _plain)
    longest = F.get(F.array_sort(F.filter(paragraphs, lambda p: F.length(p) > 80), lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    goods = F.coalesce(_section(F.col("html"), GOODS_HEADINGS), longest)
    number, body = r"\b([A-Z]{1,3}\d{5,9})\b", _plain(F.col("html"))
    title = _plain(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title", 1))
    ruling = F.coalesce(*(F.nullif(F.regexp_extract(c, number, 1), F.lit("")) for c in (title, F.substring(body, 1, 500))))
    named = F.concat_ws(" ", _section(F.col("html"), CODE_HEADINGS), body)
    codes = F.transform(F.regexp_extract_all(named, F.lit(r"\b(\d{4}\.\d{2}(?:\.\d{2,4})?)\b"), 1), lambda c: F.substring(F.regexp_replace(c, r"\D", ""), 1, 6))
    rows = pages.select("page_id", F.coalesce(ruling, F.col("page_id").cast("string")).alias("source_id"), F.substring(goods, 1, MAX_TEXT).alias("description"), F.posexplode(codes).alias("pos", "code"))
    counted = rows.where("description IS NOT NULL").groupBy("page_id", "source_id", "description", "code").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("page_id", "source_id", "description").agg(F.max_by("code", F.struct("n", -F.col("first"))).alias("hs_code"))
    return best.select("page_id", F.lit("cross_ruling").alias("source"), "source_id", "hs_code", "description")


def links(pages: DataFrame) -> DataFrame:
    """Distinct canonical addresses that pages link to: lower-case scheme and
    host, without fragment and tracking parameters."""
    each = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), 1)).alias("url"))
    return each.select(canonical_url(F.col("url")).alias("url")).where("url <> ''").distinct()


def canonical_url(url: Column) -> Column:
    clean = F.regexp_replace(F.trim(url), "#.*$", "")
    clean = F.regexp_replace(clean, r"(?i)([?&])(?:utm_[a-z]+|ref)=[^&]*&?", "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, "[?&]+$", ""), "/+$", "")
    root = F.regexp_extract(clean, r"^([A-Za-z]+://[^/?]*)", 1)
    return F.concat(F.lower(root), F.substring(clean, F.length(root) + 1, F.length(clean)))


def country_rules(kind: Column, own: Column, other: Column) -> Column:
    """routes of a restriction of a country: ``export_to`` is a route to it,
    ``import_from`` one from it, ``both`` the two, else one open at both ends."""
    none = F.lit(None).cast("string")
    route = lambda a, b: F.struct(a.alias("rule_origin"), b.alias("rule_destination"))
    to, out = route(other, own), route(own, other)
    return F.when(kind == "export_to", F.array(to)).when(kind == "import_from", F.array(out)).when(kind == "both", F.array(to, out)).when(own.isNotNull() & other.isNotNull(), F.array(out)).otherwise(F.array(route(none, none)))


def read_usml(spark: SparkSession, path: str) -> DataFrame:
    """A munitions list; ids are made of category, paragraph and content."""
    raw = read_csv(spark, path)
    col = lambda *n: find(raw, n, required=False)
    opt = lambda c: F.lit(None).cast("string") if c is None else c
    cat, para, text = find(raw, ("usml_category", "category")), opt(col("paragraph")), find(raw, TEXT_HEADERS)
    head = F.concat(F.lit("USML-"), F.trim(cat), F.coalesce(F.trim(para), F.lit("")))
    return raw.where(F.trim(text) != "").select(
        F.lit("ITAR").alias("source"), F.concat(head, F.lit("-"), F.substring(F.sha1(text), 1, 10)).alias("source_record_id"),
        F.substring(F.concat_ws(" ", F.concat(F.lit("[USML "), F.trim(cat), F.coalesce(F.trim(para), F.lit("")), F.lit("]")), F.trim(text)), 1, MAX_TEXT).alias("description"),
        level_codes(split_codes(opt(col("hs_codes", "hs_code")))).alias("hs_codes"), F.coalesce(F.trim(opt(col("restriction_type"))), F.lit("license_required")).alias("restriction_type"),
        F.lit("US").alias("rule_origin"), F.lit(None).cast("string").alias("rule_destination"),
    )


def with_crosswalk(controls: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Controls (``control_code, ...``) with all tariff codes that a
    crosswalk (``control_code, hs_code``) gives them; none is an empty list."""
    clean = lambda c: F.upper(F.regexp_replace(c, r"\s", ""))
    own = crosswalk.select(clean(F.col("control_code")).alias("__c"), F.explode(level_codes(split_codes(F.col("hs_code")))).alias("code"))
    own = own.groupBy("__c").agg(F.array_sort(F.collect_set("code")).alias("hs_codes"))
    return controls.join(own, clean(controls["control_code"]) == own["__c"], "left").drop("__c").withColumn("hs_codes", F.coalesce("hs_codes", F.array().cast("array<string>")))


def read_annex(raw: DataFrame, source: str, country: str) -> DataFrame:
    """An annex of goods with tariff codes and a direction: rows without a
    usable code are dropped; routes follow the direction."""
    direction = find(raw, ("direction",), required=False)
    direction = F.lit("export_to") if direction is None else F.lower(F.trim(direction))
    out = raw.select(
        F.lit(source).alias("source"), F.trim(find(raw, TEXT_HEADERS)).alias("description"),
        level_codes(split_codes(find(raw, ("hs_codes", "hs_code", "cn_code", "cn code", "code")))).alias("hs_codes"), F.lit("blocked").alias("restriction_type"),
        country_rules(direction, F.lit(country), F.lit(None).cast("string")).alias("routes"),
    )
    record = F.concat(F.lit(f"{source}-"), F.substring(F.sha1("description"), 1, 12))
    return out.where((F.size("hs_codes") > 0) & (F.col("description") != "")).withColumn("source_record_id", record)


def country_program(spark: SparkSession, program: dict) -> DataFrame:
    """A parsed country program (``yaml.safe_load`` of its file).

    Wrong programs raise: ``source``, a country code of two letters, a list of
    restrictions, codes of 2, 4 or 6 digits.  Rows without description are
    skipped; ids come from the content, so that a new row moves no other's.
    """
    country, rows = str(program.get("country_iso", "")).upper(), program.get("restrictions")
    if not program.get("source") or len(country) != 2 or not country.isalpha() or not isinstance(rows, list):
        raise ValueError("a program needs source, a two-letter country_iso, and a list of restrictions")
    out = []
    for r in rows:
        codes = [c for c in (("".join(filter(str.isdigit, str(x)))) for x in r.get("hs_codes") or [])]
        if any(len(c) not in (2, 4, 6) for c in codes):
            raise ValueError(f"codes of 2, 4 or 6 digits are needed: {r.get('hs_codes')}")
        if str(r.get("description") or "").strip():
            out.append((str(r["description"]).strip()[:MAX_TEXT], codes, r.get("restriction_type", "blocked"), r.get("direction", "export_to")))
    df = spark.createDataFrame(out, "description string, hs_codes array<string>, restriction_type string, direction string")
    return df.select(
        F.lit(program["source"]).alias("source"), F.concat(F.lit(f"{program['source']}-"), F.substring(F.sha1("description"), 1, 12)).alias("source_record_id"),
        "description", F.array_distinct("hs_codes").alias("hs_codes"), "restriction_type", F.lit(program.get("provenance_url")).alias("provenance_url"),
        country_rules(F.col("direction"), F.lit(country), F.lit(None).cast("string")).alias("routes"),
    )


def keywords(raw: DataFrame, length: int = MAX_KEYWORD_LEN) -> DataFrame:
    """The keywords of a list file (``pos`` and a keyword column):
    trimmed, of 3 characters at least, the first spelling of each, and of that
    the first ``length`` characters; ``pos`` is the order in the file."""
    col = F.trim(find(raw, KEYWORD_HEADERS))
    rows = raw.select(col.alias("keyword"), "pos").where(F.length("keyword") >= 3)
    first = rows.groupBy(F.lower("keyword").alias("k")).agg(F.min_by("keyword", "pos").alias("keyword"), F.min("pos").alias("pos"))
    return first.select(F.substring("keyword", 1, length).alias("keyword"), "pos", F.substring(F.sha1("k"), 1, 12).alias("record"))


def read_shipments(spark: SparkSession, path: str) -> DataFrame:
    """A batch file with ``row_index``; origins and destinations are
    cleaned, rows that cannot be screened carry an ``error``."""
    from cargolore.functions.predicates import iso

    raw = read_csv(spark, path)
    text = find(raw, ("commodity_text",))
    opt = lambda n: F.lit(None).cast("string") if (c := find(raw, (n,), required=False)) is None else c
    # an id is the number of its partition and the place in it: counts of partitions
    # (a row each) make places in the file of them
    raw = raw.withColumn("__id", F.monotonically_increasing_id())
    sizes = raw.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    raw = raw.join(F.broadcast(sizes), F.shiftright("__id", 33) == F.col("__part"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    bad = lambda n: F.when((F.trim(opt(n)) != "") & iso(opt(n)).isNull(), F.lit(f"{n} is not a country code"))
    return raw.withColumn("row_index", place).select(
        "row_index", opt("external_ref").alias("external_ref"), text.alias("commodity_text"), opt("cargo_text").alias("cargo_text"),
        iso(opt("origin_iso")).alias("origin_iso"), iso(opt("destination_iso")).alias("destination_iso"),
        F.coalesce(F.when(F.coalesce(F.trim(text), F.lit("")) == "", "commodity_text is empty"), bad("origin_iso"), bad("destination_iso")).alias("error"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``description, hs_code``; blank lines and ``#`` lines are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return lines.select(F.from_json("value", "description string, hs_code string").alias("j")).select("j.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("query"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
