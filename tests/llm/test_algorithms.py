"""Near-duplicates, neighbours, names and scans against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import names, neardup, neighbours, scan
from quillon.llm.perceptron import AveragedPerceptron
from tests.llm.helpers import crowded, rows


def texts(seed, families=40, copies=4):
    random.seed(seed)
    out = []
    for f in range(families):
        base = [f"w{random.randrange(2000)}" for _ in range(random.choice([45, 80, 200]))]
        for c in range(copies):
            t = list(base)
            for _ in range(random.randrange(0, len(t) // 8)):
                t[random.randrange(len(t))] = f"e{random.randrange(10**6)}"
            out.append((f"k{f}-{c}", " ".join(t)))
    return out


def test_near_duplicates(spark):
    data = texts(1)
    data += [("copy", data[0][1]), ("copy2", data[0][1].upper().replace(" ", ",\n")), data[0], ("n", None), ("e", ""), ("s", "short one"), (None, data[0][1]), ("long", "z " * 60_000)]
    df = crowded(spark.createDataFrame(data, "key string, text string").withColumn("scope", F.lit("s")))
    sets = {k: (w, {tuple(w[i : i + 3]) for i in range(len(w) - 2)}) for k, t in data if k and t for w in [re.findall(r"\w+", t.lower())]}
    want = set()
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and min(len(x[0]), len(y[0])) >= 40 and len(x[1] & y[1]) >= 0.7 * len(x[1] | y[1]):
                want.add(("s", a, b))
    nd = neardup.NearDuplicates(df, "scope", "key", "text", size=3, similarity=0.7, least_words=40)
    assert {*rows(nd.pairs())} == want
    classes = {r["key"]: (r["class_id"], r["links"]) for r in nd.classes().collect()}
    assert {k for k in classes} == {k for k in sets if len(sets[k][0]) >= 40}
    for _, a, b in want:
        assert classes[a][0] == classes[b][0]
    assert all(n == sum(k in p for p in want) for k, (_, n) in classes.items())
    assert neardup.NearDuplicates(df.limit(0), "scope", "key", "text").pairs().count() == 0


def test_hot_trie_is_cut_into_blocks(spark):
    """All sets in one band: the trie is larger than HOT, so blocks meet in pairs, and no pair is lost."""
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, (50, 2))
    ids = [(i, int(base[i % 50][0] ^ (1 << (i % 7))), int(base[i % 50][1]), 9, [1]) for i in range(700)]
    df = spark.createDataFrame(ids, "id long, hi long, lo long, size int, bands array<long>")
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if i % 50 == j % 50}
    kept, neardup.HOT = neardup.HOT, 64
    try:
        got = rows(neardup.similar_sets(df, 2))
    finally:
        neardup.HOT = kept
    assert {*got} >= want and all(bin((ids[a][1] ^ ids[b][1]) & (2**64 - 1)).count("1") <= 2 for a, b in got)
    assert len(got) == len(set(got))


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 2**63, 400, dtype=np.uint64) & np.uint64(0x0F0F) for _ in "12")
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    cut = ([0, 150], [150, 400])
    walked = neardup.Walked()
    got = {*zip(*(x.tolist() for x in neardup.trie_join([hi, lo], cut, cut, [4, 4], walked)))}
    want = {(i, j) for a, b in zip(*cut) for i in range(a, b) for j in range(i + 1, b) if bin(int(hi[i] ^ hi[j])).count("1") + bin(int(lo[i] ^ lo[j])).count("1") <= 4}
    assert {(min(p), max(p)) for p in got} == want
    # node pairs are given up long before all pairs of members are looked at
    assert 0 < walked.pruned < walked.visited
    hi, lo = (np.sort(rng.integers(0, 2**63, 4000, dtype=np.uint64)) for _ in "12")
    walked = neardup.Walked()
    one = ([0], [4000])
    found = {*zip(*(x.tolist() for x in neardup.trie_join([hi, lo], one, one, [0, 128], walked)))}
    assert not found and walked.visited < 40_000  # a leading word without errors: of 8 million pairs none is formed


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs of exactly 0.70: 140 three-word sequences in both, 30 more in either one."""
    data = []
    for f in range(400):
        both = [f"b{f}x{i}" for i in range(142)]
        data += [(f"a{f}", " ".join(both + [f"l{f}y{i}" for i in range(30)])), (f"b{f}", " ".join(both + [f"r{f}y{i}" for i in range(30)]))]
    df = spark.createDataFrame(data, "key string, text string").selectExpr("'s' AS scope", "*")
    nd = neardup.NearDuplicates(df, "scope", "key", "text", size=3, similarity=0.7, least_words=40)
    assert {tuple(r)[1:] for r in nd.pairs().collect()} == {(f"a{f}", f"b{f}") for f in range(400)}


def vectors(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    return [(f"k{i:04d}", (centres[i % len(centres)] + 0.12 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def exact(data, k, least):
    keys = [x for x, _ in data]
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    return {a: [b for _, b in sorted((-round(s[i, j], 6), b) for j, b in enumerate(keys) if j != i and s[i, j] >= least)[:k]] for i, a in enumerate(keys)}


def test_neighbours(spark):
    data = vectors(600)
    same = [("a1", [1.0] * 16), ("a2", [2.0] * 16), ("a3", [1.0] * 16), ("a4", [1.0] * 16)]
    odd = [("z", [0.0] * 16), ("n", None), ("w", [1.0]), ("f", [float("nan")] * 16), (None, [1.0] * 16), data[0]]
    df = crowded(spark.createDataFrame(data + same + odd, "key string, vector array<double>"))
    g = neighbours.NeighbourGraph(df, "key", "vector")
    got = {}
    for r in g.neighbours(5, 0.85).collect():
        got.setdefault(r["key"], set()).add(r["neighbour"])
    want = exact(data + same, 5, 0.85)
    hits = sum(len(set(v) & got.get(k, set())) for k, v in want.items())
    assert g.shares[-1] < neighbours.SETTLED and hits >= 0.999 * sum(map(len, want.values())) and got["a1"] == {"a2", "a3", "a4"}
    assert not set(got) & {"z", "n", "w", "f"}
    found = g.search(df.where("key LIKE '%00'"), "key", "vector", k=5)
    best = exact(data + same, 5, -1)
    share = [len({r["neighbour"] for r in found.where(F.col("key") == k).collect()} & {k, *best[k]}) / 5 for k in ("k0000", "k0100")]
    assert min(share) >= 0.8
    empty = neighbours.NeighbourGraph(df.limit(0), "key", "vector")
    assert empty.neighbours(5, 0.85).count() == 0


def test_hot_bucket_of_neighbours(spark):
    """All vectors near one point: one bucket over WINDOW and hubs; the rounds find what the windows miss."""
    rng = np.random.default_rng(4)
    data = [(f"k{i:05d}", (np.ones(16) + 0.02 * rng.standard_normal(16)).tolist()) for i in range(2500)]
    df = spark.createDataFrame(data, "key string, vector array<double>")
    got = {}
    shares = []
    for rounds in (0, 6):
        got.clear()
        for r in neighbours.NeighbourGraph(df, "key", "vector", rounds=rounds).neighbours(5, 0.85).collect():
            got.setdefault(r["key"], set()).add(r["neighbour"])
        want = exact(data, 5, 0.85)
        shares.append(sum(len(set(v) & got.get(k, set())) for k, v in want.items()) / sum(map(len, want.values())))
    assert shares[0] < 0.8 and shares[1] >= 0.95, shares


def test_pairs_that_no_link_leads_to(spark, monkeypatch):
    """Vectors that have one neighbour each, far from all others: the cells of one round find most of what the first bucket parts."""
    monkeypatch.setattr(neighbours, "CELL", 128, raising=False)
    rng = np.random.default_rng(5)
    one = rng.standard_normal((1500, 64))
    two = one + 0.3 * rng.standard_normal(one.shape)
    rows = [(f"{side}{i:04d}", v.tolist()) for side, m in (("a", one), ("b", two)) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "key string, vector array<double>")
    got = {(r["key"], r["neighbour"]) for r in neighbours.NeighbourGraph(df, "key", "vector", rounds=1).neighbours(5, 0.85).collect()}
    assert len(got & {(f"{x}{i:04d}", f"{y}{i:04d}") for i in range(1500) for x, y in ("ab", "ba")}) >= 0.9 * 3000


def test_search_in_two_spaces(spark):
    """The same keys in two columns: a search stays in the column of its query."""
    data = vectors(300, 2)
    other = [(k, v[::-1]) for k, v in vectors(300, 3)]
    df = spark.createDataFrame([(k, 0, v) for k, v in data] + [(k, 1, v) for k, v in other], "key string, space int, vector array<double>")
    asked = df.where("key LIKE '%0'")
    found = {}
    for r in neighbours.NeighbourGraph(df, "key", "vector", "space").search(asked, "key", "vector", "space", k=5).collect():
        found.setdefault((r["space"], r["key"]), set()).add(r["neighbour"])
    best = [exact(data, 4, -1), exact(other, 4, -1)]
    hits = sum(len(found[i, k] & {k, *best[i][k]}) for i in (0, 1) for k, _ in data if k.endswith("0"))
    assert hits >= 0.99 * 5 * len(found) and len(found) == 60


def edits(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_enumerates_all_near_words():
    random.seed(1)
    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(150)}
    trie = names.Trie(words)
    for w in list(words)[:40] + ["", "abcabc", "cab"]:
        for bound in (0, 1, 2):
            assert {x for x, _ in trie.near(w, bound)} == {x for x in words if edits(w, x) <= bound}


def test_names(spark):
    people = spark.createDataFrame([(1, "Margaret K. Lunpálano"), (2, "Yuki S. Lunpálano"), (3, "Nikolai Vogh"), (4, "Åse Hükskurquist"), (5, None)], "author_id long, full_name string")
    typed = ["Margaret K. Lunpálano", "Lunpalano, Peggy", "m. k lunpálano", "LUNPÁLANO MK", "Lunpláano, M.", "Y Lunpálano", "Edda Lunpálano", "Kolya Vogh", "N. Vogg", "\\AA. H\\\"ukskurquist", "Lunpálano", "", None, "M. X. Lunpálano", "Маrgaret K. Lunpálano", "x" * 5000]
    df = crowded(spark.createDataFrame([(t,) for t in typed + typed], "name string"))
    got = dict(rows(names.link_names(df, people, "persons", "name", "author_id", "full_name")))
    assert got == {typed[0]: 1, typed[1]: 1, typed[2]: 1, typed[3]: 1, typed[4]: 1, typed[5]: 2, typed[7]: 3, typed[8]: 3, typed[9]: 4, typed[14]: 1}
    results = spark.createDataFrame([(1, "Zivmbith–Quist Smooth Flow Lemma"), (2, "Zivmbith Theorem")], "result_id long, canonical_name string")
    typed = ["The Quist–Zivmbith Lem.", "smooth flow lemma of Zivmbiht and Quist", "Zivmbith's thm.", "Zivmbith Lemma", "Zivmbith Wild Flow Theorem", "Zivmbith-Quist Smooth Flow Theorem", None, ""]
    df = spark.createDataFrame([(t,) for t in typed], "name string")
    assert dict(rows(names.link_names(df, results, "results", "name", "result_id", "canonical_name"))) == {typed[0]: 1, typed[1]: 1, typed[2]: 2}
    assert names.link_names(df.limit(0), results, "results", "name", "result_id", "canonical_name").count() == 0
    assert names.link_names(df, results.limit(0), "results", "name", "result_id", "canonical_name").count() == 0


def test_shards_of_a_registry_change_nothing(spark):
    """A name one edit from an entity of one shard and equal to one of another means the latter; a tie over shards means none."""
    people = spark.createDataFrame([(1, "Maria Keller"), (2, "Maria Kellner"), (3, "Otto Brandt"), (4, "Otto Brandl")], "author_id long, full_name string")
    df = spark.createDataFrame([("Maria Keller",), ("M. Kellner",), ("Otto Brandx",)], "name string")
    kept = names.SHARD_NAMES
    for names.SHARD_NAMES in (1, 3, 50_000):
        try:
            assert dict(rows(names.link_names(df, people, "persons", "name", "author_id", "full_name"))) == {"Maria Keller": 1, "M. Kellner": 2}
        finally:
            names.SHARD_NAMES = kept


def test_perceptron_learns_on_held_out_rows():
    random.seed(0)
    data = [((f"a{a}", f"b{b}"), "x" if a > b else "y") for a, b in ((random.randrange(9), random.randrange(9)) for _ in range(900))]
    model = AveragedPerceptron(["x", "y"]).fit(data[:700])
    assert sum(model.predict(f) == c for f, c in data[700:]) >= 190


def book(seed, pages=60):
    """Scanned rows with known defects, and the clean text they were made of."""
    random.seed(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("co", "re", "in", "mani", "semi", "tra") for b in ("hom", "duc", "fold", "vari", "metr") for c in ("ology", "ation", "ical", "ent", "ing")]
    clean, scanned, defects = [], [], set()
    for p in range(pages):
        words = [random.choice(vocabulary) for _ in range(90)]
        clean.append((f"c{p}", " ".join(words) + ".", False))
        lines, line, at, key = [], [], 0, f"t{p}"
        for w in words:
            if random.random() < 0.02 and "m" in w:
                w = ("misread", w.replace("m", "rn", 1))
            line.append(w)
            if len(line) == 8:
                lines.append(line)
                line = []
        text = ""
        for n, l in enumerate(lines):
            for w in l:
                if isinstance(w, tuple):
                    defects.add((key, len(text), "misread"))
                    w = w[1]
                text += w + " "
            text = text.rstrip() + "\n"
            if n % 3 == 1:
                w = random.choice(vocabulary)
                defects.add((key, len(text) + 3, "hyphen"))
                text += f"{w[:3]}-\n{w[3:]} "
            if n == 5:
                defects.add((key, len(text) + 6, "page_no"))
                text += f"      - {p} -\n\f"
                defects.add((key, len(text), "header"))
                text += "ALGEBRAIC MANIFOLDS\n"
        scanned.append((key, text + "End.", True, p))
    return clean, scanned, defects


def test_scan(spark):
    clean, scanned, defects = book(3)
    data = [(k, t, s, None, None) for k, t, s in clean] + [(k, t, s, p, p + 1) for k, t, s, p in scanned]
    data += [("n", None, True, 1, 1), ("e", "", True, 1, 1), (None, "x", True, 1, 1), data[-1], ("u", "text", None, None, None)]
    df = crowded(spark.createDataFrame(data, "chunk_id string, body_text string, scanned boolean, page_start int, page_end int").withColumn("book", F.lit("b")))
    s = scan.Scan(df, "chunk_id", "body_text", "scanned", "book", "page_start", "page_end")
    got = {*rows(s.defects)}
    for kind in ("hyphen", "page_no", "header", "misread"):
        have, want = ({x for x in y if x[2] == kind} for y in (got, defects))
        assert len(have & want) >= 0.95 * len(want) and len(have - want) <= 0.05 * len(want), kind
    repaired = dict(rows(s.paragraphs()))
    assert all("\n" not in t and "ALGEBRAIC" not in t and "- \f" not in t for t in repaired.values())
    none = scan.Scan(df.limit(0), "chunk_id", "body_text", "scanned", "book", "page_start", "page_end")
    assert none.defects.count() == 0
