"""Feeds and logs as text columns or files to rows: OAI-PMH and Atom XML, JSON works, exposition text, TSV and JSON logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OAI = "struct<error:struct<_code:string>,ListRecords:struct<record:array<struct<header:struct<_status:string,identifier:string,datestamp:string,setSpec:array<string>>>>,resumptionToken:string>>"
ATOM = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>>>"
WORK = "struct<id:string,doi:string,title:string,publication_year:int,referenced_works:array<string>,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,topics:array<struct<display_name:string>>>"


def _unprefixed(xml: Column) -> Column:
    """XML without name-space prefixes and declarations."""
    return F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")


def oai_records(pages: DataFrame, xml: str) -> DataFrame:
    """(identifier, datestamp, sets, deleted, token) of ListRecords pages.

    ``noRecordsMatch`` is an empty page; any other error code raises when the rows are read.
    """
    p = pages.select(F.from_xml(_unprefixed(F.col(xml)), OAI).alias("p"))
    code = F.col("p.error._code")
    checked = p.where(code.isNull() | (code != "noRecordsMatch")).withColumn("p", F.when(code.isNotNull(), F.raise_error(F.concat(F.lit("OAI error "), code)).cast(OAI)).otherwise(F.col("p")))
    token = F.nullif(F.trim("p.ListRecords.resumptionToken"), F.lit(""))
    r = checked.select(token.alias("token"), F.explode("p.ListRecords.record.header").alias("h"))
    return r.select("h.identifier", "h.datestamp", F.col("h.setSpec").alias("sets"), (F.coalesce(F.col("h._status"), F.lit("")) == "deleted").alias("deleted"), "token")


def atom_entries(pages: DataFrame, xml: str) -> DataFrame:
    """(paper_id, version, title, summary, published, authors, categories) of feed pages; the version is cut from the id."""
    e = pages.select(F.explode(F.from_xml(_unprefixed(F.col(xml)), ATOM).entry).alias("e"))
    raw = F.regexp_extract("e.id", r"/abs/(.+)$", 1)
    return e.select(
        F.regexp_replace(raw, r"v\d+$", "").alias("paper_id"), F.nullif(F.regexp_extract(raw, r"(v\d+)$", 1), F.lit("")).alias("version"),
        F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"), F.trim(F.regexp_replace("e.summary", r"\s+", " ")).alias("summary"),
        "e.published", F.transform("e.author", lambda a: a["name"]).alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"),
    )


def inverted_text(index: Column) -> Column:
    """The text of a map from words to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("at"), e.key.alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x.word), " ")


def works(rows: DataFrame, raw: str) -> DataFrame:
    """(work, title, year, abstract, authors, topics, references) of JSON works; ids without their URL."""
    w = rows.select(F.from_json(raw, WORK).alias("w")).where("w IS NOT NULL")
    short = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    return w.select(
        short(F.col("w.id")).alias("work"), "w.title", F.col("w.publication_year").alias("year"), inverted_text(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.array_join(F.transform("w.authorships", lambda a: a.author.display_name), ", ").alias("authors"),
        F.array_join(F.array_distinct(F.transform("w.topics", lambda t: t.display_name)), ", ").alias("topics"),
        F.transform("w.referenced_works", short).alias("references"),
    )


def samples(lines: DataFrame, line: str) -> DataFrame:
    """(name, labels, value) of exposition text; comments and blank lines are skipped, an unreadable value is null."""
    text = lines.select(F.trim(line).alias("l")).where("l <> '' AND NOT l LIKE '#%'")
    inner = F.regexp_extract("l", r"\{(.*)\}", 1)
    pairs = F.regexp_extract_all(inner, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1), F.regexp_extract(p, r'="(.*)"$', 1))))
    number = F.regexp_extract("l", r"(\S+)$", 1)
    value = F.when(number == "+Inf", float("inf")).when(number == "-Inf", float("-inf")).otherwise(F.expr("try_cast(regexp_extract(l, '(\\\\S+)$', 1) AS double)"))
    return text.select(F.regexp_extract("l", r"^([A-Za-z_:][\w:]*)", 1).alias("name"), labels.alias("labels"), value.alias("value"))


FAILURE = "stage string, paper string, reason string, at string"


def failure_logs(tsv: DataFrame, jsonl: DataFrame, line: str) -> DataFrame:
    """(stage, paper, reason, at) of both kinds of log lines; a line that can't be read keeps its text as the reason."""
    parts = F.split(line, "\t")
    a = tsv.select(F.when(F.size(parts) >= 3, F.struct(F.lit("fetch").alias("stage"), parts[0].alias("paper"), parts[1].alias("reason"), parts[2].alias("at"))).otherwise(F.struct(F.lit("fetch").alias("stage"), F.lit(None).cast("string").alias("paper"), F.concat(F.lit("unreadable: "), F.col(line)).alias("reason"), F.lit(None).cast("string").alias("at"))).alias("r"))
    j = F.from_json(line, "paper string, reason string, at string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    b = jsonl.select(j.alias("j")).select(F.struct(F.lit("parse").alias("stage"), F.col("j.paper"), F.coalesce("j.reason", F.concat(F.lit("unreadable: "), "j._corrupt")).alias("reason"), F.col("j.at")).alias("r"))
    return a.unionByName(b).select("r.*")


def membership(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a list file: one a line, blank lines and comments skipped."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("paper_id")).where("paper_id <> ''").distinct()


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, for documents that fit a row."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def main_source(files: DataFrame, paper: str) -> DataFrame:
    """The main TeX file of each paper: highest first, then one named like the paper, then one with a document class, then by name.

    ``files``: (paper, path, text).
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.struct(F.size(F.split("path", "/")), F.when(name == F.concat(F.col(paper), F.lit(".tex")), 0).when(F.col("text").contains("\\documentclass"), 1).otherwise(2), F.col("path"))
    return files.groupBy(paper).agg(F.min_by("path", rank).alias("path"))


RAW = "struct<GetRecord:struct<record:struct<metadata:struct<arXivRaw:struct<id:string,license:string,version:array<struct<_version:string,date:string>>>>>>>"


def revisions(pages: DataFrame, xml: str) -> DataFrame:
    """(paper_id, license, version, posted_at) of GetRecord pages; dates without their weekday, which Spark can't parse."""
    r = pages.select(F.from_xml(_unprefixed(F.col(xml)), RAW).GetRecord.record.metadata.arXivRaw.alias("r"))
    v = r.select(F.col("r.id").alias("paper_id"), F.nullif(F.trim("r.license"), F.lit("")).alias("license"), F.explode("r.version").alias("v"))
    day = F.regexp_replace("v.date", r"^\s*\w{3},\s*", "")
    return v.select("paper_id", "license", F.col("v._version").alias("version"), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")).alias("posted_at"))


INSPIRE = "struct<metadata:struct<titles:array<struct<title:string>>,authors:array<struct<full_name:string>>,arxiv_eprints:array<struct<value:string,categories:array<string>>>,references:array<struct<reference:struct<arxiv_eprint:string>>>,publication_info:array<struct<journal_title:string,journal_volume:string,year:int,page_start:string,page_end:string>>>>"


def inspire_records(rows: DataFrame, raw: str) -> DataFrame:
    """(paper_id, title, authors, categories, references, journal) of JSON records; lists without repeats in their order."""
    m = rows.select(F.from_json(raw, INSPIRE).metadata.alias("m")).where("m IS NOT NULL")
    p = F.try_element_at("m.publication_info", F.lit(1))
    pages = F.when(p.page_end.isNotNull(), F.concat_ws("-", p.page_start, p.page_end)).otherwise(p.page_start)
    named = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
    return m.select(
        F.try_element_at("m.arxiv_eprints", F.lit(1)).value.alias("paper_id"), F.try_element_at("m.titles", F.lit(1)).title.alias("title"),
        F.array_join(F.transform("m.authors", lambda a: a["full_name"]), "; ").alias("authors"),
        named(F.flatten(F.transform("m.arxiv_eprints", lambda e: e["categories"]))).alias("categories"),
        named(F.transform("m.references", lambda r: r["reference"]["arxiv_eprint"])).alias("references"),
        F.nullif(F.concat_ws(" ", p.journal_title, p.journal_volume, F.when(p.year.isNotNull(), F.concat(F.lit("("), p.year.cast("string"), F.lit(")"))), pages), F.lit("")).alias("journal"),
    )


def render_state(html: Column) -> Column:
    """Why a rendered page is of no use, or ``ok``: empty, an error banner, or no formula."""
    return F.when(F.trim(F.coalesce(html, F.lit(""))) == "", "empty").when(F.lower(html).contains("could not be processed"), "banner").when(~html.rlike(r"<math\b|\$"), "no_math").otherwise("ok")
