"""The scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.plans._read import table


def math_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def name_keys(spark, sf):
    return table(spark, sf, "theorem_names").select("dedup_key", text.name_key("display_name").alias("name_key"))


def name_trigrams(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", F.array_join(F.array_sort(text.trigrams(F.col("p_name"))), "|").alias("grams"))


def distance_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    d = F.aggregate(F.zip_with("embedding", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(vectors.distance_score(d), 6).alias("score"), F.round(F.least(F.lit(1.0), vectors.distance_score(d)), 6).alias("cosine"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), vectors.unit_check(F.col("embedding")).alias("unit"))


def route_queries(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", text.route(F.col("text")).alias("route")).unionByName(table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), text.route(F.col("text")).alias("route")))


# Which model answers which route and turn.
MODELS = {("LOOKUP", "first"): "small", ("LOOKUP", "middle"): "small", ("LOOKUP", "final"): "medium", ("SYNTHESIS", "first"): "medium", ("SYNTHESIS", "middle"): "medium", ("SYNTHESIS", "final"): "large",
          ("VERIFICATION", "first"): "medium", ("VERIFICATION", "middle"): "medium", ("VERIFICATION", "final"): "large", ("AUTOFORMALIZATION", "first"): "large", ("AUTOFORMALIZATION", "middle"): "large", ("AUTOFORMALIZATION", "final"): "large"}


def model_select(spark, sf):
    """A total lookup by route and turn."""
    models = spark.createDataFrame([(r, t, m) for (r, t), m in MODELS.items()], "route string, turn string, model string")
    asked = table(spark, sf, "eval_items").select("item_id", text.route(F.col("text")).alias("route"), F.element_at(F.array(F.lit("first"), F.lit("middle"), F.lit("final")), (F.col("item_id") % 3 + 1).cast("int")).alias("turn"))
    return asked.join(F.broadcast(models), ["route", "turn"]).select("item_id", "model")


def snippets(spark, sf):
    rows = table(spark, sf, "chunks").select("chunk_id", "body_text").distinct()
    return rows.select("chunk_id", text.wrapped(text.sanitized(F.substring("body_text", 1, 150)), "chunk").alias("snippet"))


def chunk_labels(spark, sf):
    return table(spark, sf, "chunks").select("chunk_id", text.label(F.col("theorem_name"), F.col("theorem_label")).alias("label"), text.paper_of_chunk(F.col("chunk_id")).alias("paper"), F.when(F.col("kind") == "proof", "proof").otherwise("stmt").alias("route"), F.when(F.col("paper_id").startswith("textbook:"), "textbook").otherwise("arxiv").alias("source_kind")).distinct()


def content_ids(spark, sf):
    """Content addresses: the hash of position and body, of white-space-collapsed text, of length-prefixed parts."""
    docs = table(spark, sf, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.substring(F.sha2(F.concat(F.col("section_no").cast("string"), body), 256), 1, 16).alias("short_id"), F.sha2(text.collapsed(body), 256).alias("normal_hash"), F.sha2(text.prefixed(F.col("work_id"), F.col("arxiv_version"), F.col("lang")), 256).alias("identity"))


def revision_ids(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.when(F.coalesce("arxiv_version", F.lit("")) != "", F.concat_ws("@", "work_id", "arxiv_version")).otherwise(F.col("work_id")).alias("revision"), F.to_json(F.struct(F.col("work_id").alias("id"), F.col("arxiv_version").alias("rev"))).alias("span"))


def fetched_times(spark, sf):
    """ISO times in several spellings; without a zone they are UTC."""
    t = F.coalesce(F.try_to_timestamp(F.regexp_replace("fetched_at", "Z$", "+00:00")), F.try_to_timestamp("fetched_at"))
    return table(spark, sf, "documents").select("doc_id", F.unix_micros(t).alias("fetched_us"))


def strip_comments(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", text.collapsed(F.regexp_replace("text", r"\\leq", "%")).alias("t")).select("doc_id", F.length(text.strip_tex_comments(F.col("t"))).cast("long").alias("kept"))


def formula_atoms(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"\$([^$]*)\$", 1).alias("f")).where("f <> ''")
    return rows.select("doc_id", F.array_join(text.latex_atoms(F.col("f")), " ").alias("atoms"))


def all_formula_atoms(spark, sf):
    """The atoms of every formula of each document, by its 1-based place; ``formula_atoms`` has the first formulas only."""
    f = F.regexp_extract_all("text", F.lit(r"\$([^$]*)\$"), F.lit(1))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(f).alias("place", "f")).where("f <> ''")
    return rows.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.array_join(text.latex_atoms(F.col("f")), " ").alias("atoms"))


def json_fields(spark, sf):
    """Lists in JSON text: their sizes, and categories without repeats in their order."""
    p = table(spark, sf, "paper_metadata").groupBy("paper_id").agg(F.max("authors").alias("a"), F.max("categories").alias("c"))
    lists = p.select("paper_id", F.from_json("a", "array<string>").alias("a"), F.from_json("c", "array<string>").alias("c"))
    return lists.select("paper_id", F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n_authors"), F.array_join(F.array_distinct("c"), ", ").alias("cats"))


def usable_metadata(spark, sf):
    """Rows with title and authors; year 0, empty abstract and empty lists are null."""
    p = table(spark, sf, "paper_metadata").select("paper_id", F.nullif("title", F.lit("")).alias("title"), F.from_json("authors", "array<string>").alias("a"), F.nullif(F.col("year"), F.lit(0)).cast("long").alias("year"), F.nullif("abstract", F.lit("")).alias("abstract"), F.nullif("primary_category", F.lit("")).alias("category"))
    return p.where("title IS NOT NULL AND size(a) > 0").select("paper_id", "title", F.array_join("a", ", ").alias("authors"), "year", "abstract", "category").distinct()


def ordered_json(spark, sf):
    """Objects with their keys in order, as text."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    return e.select("event_id", F.to_json(F.struct("event_type", "k")).alias("payload"))


def licence_decisions(spark, sf):
    """URI to status: an allowed licence, an open one that isn't on the list, or unknown."""
    uri = F.lower(F.coalesce("license", F.lit("")))
    known = F.when(uri.rlike("cc-by-4.0|cc-by-sa-4.0|cc0"), "eligible").when(uri.startswith("cc-") | uri.contains("creativecommons"), "open_not_listed").otherwise("unknown")
    return table(spark, sf, "chunks").select("chunk_id", known.alias("status")).distinct()


def inverted_index_roundtrip(spark, sf):
    """Words of a text inverted to their places and put together again."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("at", "word"))
    inverted = docs.groupBy("doc_id", "word").agg(F.collect_list("at").alias("places"))
    back = inverted.select("doc_id", "word", F.explode("places").alias("at")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return back.select("doc_id", F.array_join(F.transform("w", lambda x: x.word), " ").alias("text"))


_TOK = r"regexp_extract_all(replace(text, '$', ' '), '\\[A-Za-z@]+\{[A-Za-z0-9]+\}|\\[A-Za-z@]+|[A-Za-z][_^](?:\{[A-Za-z0-9]+\}|[A-Za-z0-9])|\p{L}(?:(?:\p{L}|-)*\p{L})?')"
_ONE = r"CASE WHEN starts_with(t, '\') THEN replace(replace(substring(t, 2), '{', '_'), '}', '') WHEN regexp_matches(t, '^[A-Za-z][_^]') THEN substring(t, 1, 1) || '_' || replace(replace(substring(t, 3), '{', ''), '}', '') ELSE t END"
_Q = "trim(regexp_replace(substring(text, 1, 200), '\\s+', ' ', 'g'))"
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches({_Q}, '(?i){'|'.join(p)}') THEN '{t}'" for t, p in text.ROUTES.items()) + " ELSE 'LOOKUP' END"
_PREF = "lpad(strlen(coalesce({0}, ''))::VARCHAR, 8, '0') || coalesce({0}, '')"

QUERIES = {f.__name__: f for f in (math_tokens, name_keys, name_trigrams, distance_scores, route_queries, model_select, snippets, chunk_labels, content_ids, revision_ids, fetched_times, strip_comments, formula_atoms, all_formula_atoms, json_fields, usable_metadata, ordered_json, licence_decisions, inverted_index_roundtrip)}
ORACLE_SQL = {
    "math_tokens": f"SELECT doc_id, array_to_string(list_transform({_TOK}, lambda t: {_ONE}), ' ') AS tokens FROM documents",
    "name_keys": "SELECT dedup_key, regexp_replace(strip_accents(lower(display_name)), '[^a-z0-9]', '', 'g') AS name_key FROM theorem_names",
    "name_trigrams": "SELECT p_name, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(p_name) - 1, 2)), lambda i: substring(p_name, i, 3)))), '|') AS grams FROM (SELECT DISTINCT p_name FROM part)",
    "distance_scores": "SELECT vec_id, round(greatest(0.0, 1 - d / 2), 6) AS score, round(least(1.0, greatest(0.0, 1 - d / 2)), 6) AS cosine, round(sqrt(n), 6) AS norm, abs(sqrt(n) - 1) <= 1e-3 AS unit FROM (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d, list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x)) AS n FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q)",
    "route_queries": f"SELECT item_id, {_ROUTE} AS route FROM eval_items UNION ALL SELECT doc_id, {_ROUTE} FROM documents WHERE text IS NOT NULL",
    "model_select": f"SELECT item_id, model FROM (SELECT item_id, {_ROUTE} AS route, ['first', 'middle', 'final'][item_id % 3 + 1] AS turn FROM eval_items) JOIN (VALUES {', '.join(repr((r, t, m)) for (r, t), m in MODELS.items())}) AS v(route, turn, model) USING (route, turn)",
    "snippets": "SELECT chunk_id, CASE WHEN length(b) > 0 THEN '<chunk>' || replace(replace(b, '</chunk>', '&lt;/chunk&gt;'), '<chunk>', '&lt;chunk&gt;') || '</chunk>' ELSE '' END AS snippet FROM (SELECT DISTINCT chunk_id, substring(body_text, 1, 150) AS b, body_text FROM chunks)",
    "chunk_labels": "SELECT DISTINCT chunk_id, nullif(concat_ws(' ', nullif(theorem_name, ''), nullif(theorem_label, '')), '') AS label, regexp_extract(chunk_id, '^(?:arxiv:)?(.*):[0-9a-f]{16}$', 1) AS paper, CASE WHEN kind = 'proof' THEN 'proof' ELSE 'stmt' END AS route, CASE WHEN starts_with(paper_id, 'textbook:') THEN 'textbook' ELSE 'arxiv' END AS source_kind FROM chunks",
    "content_ids": f"SELECT doc_id, substring(sha256(section_no::VARCHAR || coalesce(text, '')), 1, 16) AS short_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS normal_hash, sha256({_PREF.format('work_id')} || {_PREF.format('arxiv_version')} || {_PREF.format('lang')}) AS identity FROM documents",
    "revision_ids": """SELECT doc_id, CASE WHEN coalesce(arxiv_version, '') <> '' THEN work_id || '@' || arxiv_version ELSE work_id END AS revision, '{"id":"' || work_id || '","rev":"' || arxiv_version || '"}' AS span FROM documents""",
    "fetched_times": "SELECT doc_id, epoch_us(TRY_CAST(fetched_at AS TIMESTAMPTZ)) AS fetched_us FROM documents",
    "all_formula_atoms": r"SELECT doc_id, place, array_to_string(regexp_extract_all(f, '\\[A-Za-z]+|\\.|[0-9]+|[^\s]'), ' ') AS atoms FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\$([^$]*)\$', 1)) AS f, generate_subscripts(regexp_extract_all(text, '\$([^$]*)\$', 1), 1) AS place FROM documents) WHERE f <> ''",
    "formula_atoms": r"SELECT doc_id, array_to_string(regexp_extract_all(f, '\\[A-Za-z]+|\\.|[0-9]+|[^\s]'), ' ') AS atoms FROM (SELECT doc_id, regexp_extract(text, '\$([^$]*)\$', 1) AS f FROM documents) WHERE f <> ''",
    "json_fields": """WITH p AS (SELECT paper_id, max(authors) AS a, from_json(max(categories), '["VARCHAR"]') AS c FROM paper_metadata GROUP BY 1)
 SELECT paper_id, coalesce(json_array_length(a), 0)::BIGINT AS n_authors, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ', ') AS cats FROM p""",
    "ordered_json": """SELECT event_id, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS payload FROM events""",
    "licence_decisions": "SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(lower(coalesce(license, '')), 'cc-by-4.0|cc-by-sa-4.0|cc0') THEN 'eligible' WHEN starts_with(lower(coalesce(license, '')), 'cc-') OR contains(lower(coalesce(license, '')), 'creativecommons') THEN 'open_not_listed' ELSE 'unknown' END AS status FROM chunks",
    "inverted_index_roundtrip": r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\S')",
    "usable_metadata": "SELECT DISTINCT paper_id, nullif(title, '') AS title, array_to_string(from_json(authors, '[\"VARCHAR\"]'), ', ') AS authors, nullif(year, 0)::BIGINT AS year, nullif(abstract, '') AS abstract, nullif(primary_category, '') AS category FROM paper_metadata WHERE nullif(title, '') IS NOT NULL AND json_array_length(authors) > 0",
    "strip_comments": r"SELECT doc_id, length(regexp_replace(trim(regexp_replace(replace(text, '\leq', '%'), '\s+', ' ', 'g')), '(^|[^\\])((?:\\\\)*)%.*$', '\1\2'))::BIGINT AS kept FROM documents WHERE text IS NOT NULL",
}
