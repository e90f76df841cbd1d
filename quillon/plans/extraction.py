"""Extraction over pages and sources that are put together from the test tables, so that what comes out can be checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import extract
from quillon.plans._read import table


def _labelled(spark, sf):
    c = table(spark, sf, "chunks").where("theorem_label IS NOT NULL AND kind IN ('lemma', 'proposition', 'definition', 'remark', 'corollary')")
    return c.select("chunk_id", "paper_id", "kind", F.concat(F.lit("l:"), F.regexp_replace("theorem_label", r"\.", "-")).alias("label"), F.col("body_text").alias("body")).distinct()


def html_pages(spark, sf):
    """One page a paper: its labelled statements as theorem containers."""
    safe = F.replace(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    block = F.concat(F.lit('<div class="ltx_theorem ltx_theorem_'), F.col("kind"), F.lit('" id="'), F.col("label"), F.lit('"><div class="ltx_para"><p>'), safe, F.lit("</p></div></div>"))
    return _labelled(spark, sf).groupBy("paper_id").agg(F.concat(F.lit("<html><body><article><section>"), F.array_join(F.array_sort(F.collect_list(block)), "\n"), F.lit("</section></article></body></html>")).alias("html"))


def html_statements(spark, sf):
    """Kind, label and collapsed text of each statement, read back from the pages."""
    found = extract.chunks(html_pages(spark, sf), "paper_id", "html", "html").where("kind <> 'section' AND error IS NULL")
    return found.select(F.col("key").alias("paper_id"), "kind", "label", F.sha2("body", 256).alias("body"))


def tex_statements(spark, sf):
    """The same from TeX sources, offsets included: the body is what lies between them."""
    block = F.concat(F.lit("\\begin{"), F.col("kind"), F.lit("}\\label{"), F.col("label"), F.lit("}"), F.col("body"), F.lit("\\end{"), F.col("kind"), F.lit("}"))
    tex = _labelled(spark, sf).groupBy("paper_id").agg(F.concat(F.lit("\\documentclass{article}\\newtheorem{lemma}{Lemma}[section]\\begin{document}\\section{One}"), F.array_join(F.array_sort(F.collect_list(block)), "\n"), F.lit("\\end{document}")).alias("tex"))
    found = extract.chunks(tex, "paper_id", "tex", "tex").where("kind <> 'section' AND error IS NULL")
    back = found.join(tex.withColumnRenamed("paper_id", "key"), "key").select("key", "kind", "label", F.expr("substring(tex, start + 1, end - start)").alias("cut"), "body")
    return back.select(F.col("key").alias("paper_id"), "kind", "label", F.sha2(F.expr("substring(body, length(label) + 9)"), 256).alias("body"), (F.col("cut") == F.col("body")).alias("exact"))


def markdown_packs(spark, sf):
    """Every document as Markdown: bodies hold all its words once."""
    d = table(spark, sf, "documents")
    found = extract.chunks(d, "doc_id", "text", "markdown")
    return found.groupBy(F.col("key").cast("long").alias("doc_id")).agg(F.sum(F.size(text.words(F.col("body")))).cast("long").alias("words"))


def page_segments(spark, sf):
    """Textbook bodies as page text: segments by page."""
    c = table(spark, sf, "chunks").where("source_kind = 'textbook'").select("chunk_id", "body_text").distinct()
    found = extract.chunks(c, "chunk_id", "body_text", "pages")
    return found.groupBy(F.col("key").alias("chunk_id")).agg(F.max("page").cast("long").alias("pages"))


def macro_definitions(spark, sf):
    """A preamble for each brand of parts: the last expansion of each symbol in sorted order."""
    name = F.regexp_replace("p_type", "[^A-Za-z]", "")
    line = F.concat(F.lit("\\newcommand{\\"), name, F.lit("}{"), F.col("p_name"), F.lit("} % old"))
    tex = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("tex"))
    return extract.definitions(tex, "p_brand", "tex").select(F.col("key").alias("brand"), "symbol", "expansion")


def theorem_name_rows(spark, sf):
    return extract.theorem_names(table(spark, sf, "chunks"))


_L = r"l AS (SELECT DISTINCT chunk_id, paper_id, kind, 'l:' || replace(theorem_label, '.', '-') AS label, body_text AS body FROM chunks WHERE theorem_label IS NOT NULL AND kind IN ('lemma', 'proposition', 'definition', 'remark', 'corollary'))"
QUERIES = {f.__name__: f for f in (html_statements, tex_statements, markdown_packs, page_segments, macro_definitions, theorem_name_rows)}
ORACLE_SQL = {
    "tex_statements": f"WITH {_L} SELECT paper_id, kind, label, sha256(body) AS body, true AS exact FROM l",
    "page_segments": "SELECT chunk_id, max(p)::BIGINT AS pages FROM (SELECT chunk_id, generate_subscripts(s, 1) AS p, unnest(s) AS t FROM (SELECT DISTINCT chunk_id, string_split(body_text, chr(12)) AS s FROM chunks WHERE source_kind = 'textbook')) WHERE regexp_matches(t, '\\S') GROUP BY 1",
    "macro_definitions": "SELECT p_brand AS brand, '\\' || regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS symbol, max(p_name) AS expansion FROM part GROUP BY 1, 2",
    "markdown_packs": r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}(?:(?:\p{L}|-)*\p{L})?'))::BIGINT AS words FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\s]')",
    "html_statements": rf"WITH {_L} SELECT paper_id, kind, label, sha256(trim(regexp_replace(body, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))) AS body FROM l",
}
