"""Queries that must do the whole job: what a stand-in, a fixed subset or a first match would leave out."""

import re

import numpy as np

from quillon import plans
from quillon.operators import hooks
from quillon.plans import search

QUERIES = plans.queries()


def read(spark, small, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*columns).collect()]


def test_hybrid_search_fuses_lexical_and_dense(spark, small):
    docs = dict(read(spark, small, "documents", "doc_id", "text"))
    items = dict(read(spark, small, "eval_items", "item_id", "text"))
    with_text = sorted(k for k, t in docs.items() if t is not None)
    unit = lambda x: hooks.hashing_embedder(x).astype("float32").astype(float)
    scores = np.round(np.maximum(0, unit([items[i] for i in sorted(items)]) @ unit([docs[k] for k in with_text]).T), 6)
    lexical, dense = search.hybrid_lists(spark, small, 20)
    lists = {}
    for name, df in (("lexical", lexical), ("dense", dense)):
        for r in df.collect():
            lists.setdefault((name, r["query"]), {})[r["id"]] = r["rank"]
    for i, item in enumerate(sorted(items)):
        want = sorted(range(len(with_text)), key=lambda j: (-scores[i, j], with_text[j]))[:20]
        assert lists["dense", item] == {with_text[j]: n for n, j in enumerate(want, 1)}
    assert any(set(lists["dense", i]) - set(lists.get(("lexical", i), {})) for i in items)
    deep = {}
    for df in search.hybrid_lists(spark, small):
        for r in df.collect():
            deep.setdefault(r["query"], {}).setdefault(r["id"], []).append(1 / (60 + r["rank"]))
    got = {}
    for r in QUERIES["hybrid_search"](spark, small).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["doc_id"], r["score"])
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    for item, lists_ in deep.items():
        fused = sorted(lists_, key=lambda d: (-round(sum(lists_[d]), 9), d))[:50]
        share = {d: round(len(words(items[item]) & words(docs[d])) / max(1, len(words(items[item]))), 6) for d in fused}
        assert got[item] == {n: (d, share[d]) for n, d in enumerate(sorted(fused, key=lambda d: (-share[d], d))[:10], 1)}
    assert {(r["query"], r["rank"]): r["doc_id"] for r in QUERIES["rerank_overlap"](spark, small).collect()} == {(q, n): d for q, x in got.items() for n, (d, _) in x.items() if n <= 3}


def test_hashed_embeddings_reads_every_document(spark, small):
    docs, items = read(spark, small, "documents", "doc_id", "text"), sorted(read(spark, small, "eval_items", "item_id", "text"))
    unit = lambda x: hooks.hashing_embedder(x).astype("float32").astype(float)
    among = unit([t for _, t in items])
    want = set()
    for k, t in docs:
        if t is None:
            want.add((k, None, None, None))
            continue
        s = np.round(np.maximum(0, unit([t]) @ among.T), 6)[0]
        want |= {(k, items[j][0], s[j], n) for n, j in enumerate(sorted(range(len(items)), key=lambda j: (-s[j], j))[:3], 1)}
    got = [tuple(r) for r in QUERIES["hashed_embeddings"](spark, small).select("doc_id", "item_id", "score", "rank").collect()]
    assert len(got) == len(set(got)) and {*got} == want


def test_every_formula_of_every_body(spark, tmp_path):
    one, far = [1.0, 0.0], [0.5, 0.5]
    chunks = [("s", "first $b+c$, then $a = 1$ and $x$", one, None), ("p", "so $z^2$ gives $a = 1$", None, far), ("n", "$a = 1$", None, None), ("e", "none", one, None)]
    chunks += chunks[:1] + [(f"k{i:03d}", "$q r s$ $t$", one, None) for i in range(150)]
    spark.createDataFrame(chunks, "chunk_id string, body_text string, embedding_stmt array<float>, embedding_proof array<float>").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(0, one)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(1, "$a b$ $a b$ $a c$"), (2, "$x$"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    trees = {(r["id"], r["place"]) for r in QUERIES["formula_trees"](spark, str(tmp_path)).collect()}
    assert {x for x in trees if len(x[0]) == 1} == {("s", 1), ("s", 2), ("s", 3), ("p", 1), ("p", 2)} and len(trees) == 305
    got = {(r["query"], r["id"], r["place"]): r for r in QUERIES["find_equation"](spark, str(tmp_path)).collect()}
    assert got[3, "s", 2]["ted"] == 0 and got[3, "s", 2]["rank"] == 1 and got[3, "p", 2]["ted"] == 0
    fidelity = {(r["doc_id"], r["place"]): r["f1"] for r in QUERIES["formula_fidelity"](spark, str(tmp_path)).collect()}
    assert fidelity == {(1, 1): 1.0, (1, 2): 0.5}
    atoms = {(r["doc_id"], r["place"]): r["atoms"] for r in QUERIES["all_formula_atoms"](spark, str(tmp_path)).collect()}
    assert atoms == {(1, 1): "a b", (1, 2): "a b", (1, 3): "a c", (2, 1): "x"}


def test_counter_pivot_has_every_slug(spark, small):
    runs = set(read(spark, small, "notebook_ingest_runs", "id", "slug", "status"))
    got = {r["slug"]: r["succeeded"] + r["failed"] + r["running"] for r in QUERIES["all_counter_pivot"](spark, small).collect()}
    slugs = {s for _, s, _ in runs}
    assert None not in slugs and set(got) == slugs | {"ninuvi0000", "nothing"} and got["nothing"] == 0
    assert sum(got.values()) == len(runs)
