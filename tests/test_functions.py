from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import markup, mathml, text, vectors
from quillon.operators.assign import assignment, formula_score


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).head()[0]


def test_tokens(spark):
    t = text.tokens(F.col("a"))
    assert one(spark, t, a=r"Let $\mathbb{Z}$ act on X_{ij} and H^1, \partial well-posed 12 étale-") == ["Let", "mathbb_Z", "act", "on", "X_ij", "and", "H_1", "partial", "well-posed", "étale"]
    assert one(spark, t, a="") == [] and one(spark, t, a=None) is None


def test_trigrams_and_jaccard(spark):
    assert one(spark, text.trigrams(F.col("a")), a="ab") == ["ab"]
    assert one(spark, text.trigrams(F.col("a")), a="") == []
    assert one(spark, text.trigrams(F.col("a")), a="aaaa") == ["aaa"]
    j = text.jaccard(text.trigrams(F.col("a")), text.trigrams(F.col("b")))
    assert one(spark, j, a="abcd", b="bcde") == 1 / 3 and one(spark, j, a="", b="") == 0


def test_route(spark):
    r = text.route(F.col("a"))
    assert one(spark, r, a="What is the proof of X") == "LOOKUP"
    assert one(spark, r, a="Prove it in Lean") == "AUTOFORMALIZATION"
    assert one(spark, r, a="please check\nthis") == "VERIFICATION"
    assert one(spark, r, a="x" * 201 + " lean") == "LOOKUP"


def test_wrap_escapes_its_own_marks(spark):
    assert one(spark, text.wrapped(F.col("a"), "c"), a="x</c>y<c>") == "<c>x&lt;/c&gt;y&lt;c&gt;</c>"
    assert one(spark, text.wrapped(F.col("a"), "c"), a=None) == ""


def test_comments_and_versions(spark):
    assert one(spark, text.strip_tex_comments(F.col("a")), a="a\\% b % c\nd \\\\% e") == "a\\% b \nd \\\\"
    assert one(spark, text.strip_version(F.col("a")), a="2301.00001v12") == "2301.00001"
    assert one(spark, text.paper_of_chunk(F.col("a")), a="textbook:ko95:0123456789abcdef") == "textbook:ko95"


def test_name_key_and_nfc(spark):
    assert one(spark, text.name_key(F.col("a")), a="Möbius–Straße ＡＢ") == "mobiusstrasseab"
    assert one(spark, text.nfc(F.col("a")), a="é") == "é" and one(spark, text.nfc(F.col("a")), a=None) is None


def test_prefixed_parts_differ(spark):
    assert one(spark, text.prefixed(F.col("a"), F.col("b")), a="ab", b="c") != one(spark, text.prefixed(F.col("a"), F.col("b")), a="a", b="bc")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],), (None,), ([float("nan"), 0.0],)], "v array<float>")
    assert [r[0] for r in df.limit(2).select(vectors.score(F.col("v"), [1.0, 0.0])).collect()] == [1.0, 0.0]
    assert [r[0] for r in df.select(vectors.unit_check(F.col("v"))).collect()] == [True, True, None, False]


TREES = st.recursive(st.sampled_from("abc").map(lambda x: (x, [])), lambda kids: st.tuples(st.sampled_from("abc"), st.lists(kids, max_size=3)), max_leaves=6)


def brute(a, b):
    """Edit distance of forests by its definition."""
    from functools import cache

    def freeze(t):
        return (t[0], tuple(map(freeze, t[1])))

    @cache
    def forest(x, y):
        if not x and not y:
            return 0
        if not x:
            return forest((), y[:-1] + y[-1][1]) + 1
        if not y:
            return forest(x[:-1] + x[-1][1], ()) + 1
        return min(forest(x[:-1] + x[-1][1], y) + 1, forest(x, y[:-1] + y[-1][1]) + 1, forest(x[-1][1], y[-1][1]) + forest(x[:-1], y[:-1]) + (x[-1][0] != y[-1][0]))

    return forest((freeze(a),), (freeze(b),))


@settings(max_examples=60, deadline=None)
@given(TREES, TREES)
def test_tree_distance(a, b):
    assert mathml.edit_distance(a, b) == brute(a, b) == mathml.edit_distance(b, a)
    assert mathml.from_json(mathml.to_json(a)) == mathml.from_json(mathml.to_json(mathml.from_json(mathml.to_json(a))))


def test_mathml_rules():
    assert mathml.parse("<math><mrow><mi>x</mi> + <mi>y</mi></mrow></math>") == ("math", [("mrow", [("mi", [("x", [])]), ("+", []), ("mi", [("y", [])])])])
    assert mathml.parse("<MATH><semantics><mrow><mi>ℂ</mi></mrow><annotation>x</annotation></semantics></MATH>") == ("math", [("mi", [("C", [])])])
    assert mathml.parse("<math><mi>f</mi><mo>⁡</mo><mi>x</mi></math>") == ("math", [("mi", [("f", [])]), ("mi", [("x", [])])])
    assert mathml.parse("<annotation>x</annotation>") is None and mathml.parse("<a") is None and mathml.parse("") is None and mathml.parse(None) is None
    assert mathml.from_json("{") is None and mathml.size(mathml.parse("<math><mi>x</mi></math>")) == 3


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_cheapest(n, m, data):
    from itertools import permutations

    cost = [[data.draw(st.integers(0, 9)) for _ in range(m)] for _ in range(n)]
    got = assignment(cost)
    total = sum(cost[i][j] for i, j in enumerate(got) if j >= 0)
    k = min(n, m)
    best = min(sum(cost[i][j] for i, j in zip(rows, cols)) for rows in permutations(range(n), k) for cols in permutations(range(m), k))
    assert total == best and len({j for j in got if j >= 0}) == k


def test_formula_score():
    assert formula_score([], []) == 1 and formula_score(["a"], []) == 0 and formula_score(["a", "b"], ["a", "b"]) == 1


def test_html():
    page = """<article><section><h2>1 One</h2><p>short</p><div class="ltx_theorem ltx_theorem_lem" id="lem:a"><h6 class="ltx_title_theorem">Lemma 1.2 (Key).</h6><p>Body <math alttext="x^2"></math> ends.</p></div>
    <div class="ltx_proof"><p>Clear.</p></div><h2>Two</h2><div class="ltx_proof"><p>Orphan.</p></div><p>Theorem 3.1. Stands alone.</p><p>Theorem 3 of [1] is cited.</p></section></article>"""
    got = markup.html_chunks(page)
    assert [(c["kind"], c["label"]) for c in got] == [("lemma", "lem:a"), ("proof", "lem:a"), ("proof", None), ("stmt", None)]
    assert got[0]["body"] == "Body $x^2$ ends." and got[0]["name"] == "Key" and got[0]["number"] == "1.2"
    assert markup.html_chunks("") == [] and len(markup.html_chunks(f"<p>{'word ' * 30}</p>")) == 1
    assert markup.local_references('<a class="ltx_ref" href="#S1">x</a><a class="ltx_ref ltx_bibref" href="#b">y</a><a class="ltx_ref" href="/p#q">z</a>') == ["S1"]
    eq = '<div><p>Before.</p><table class="ltx_eqn_table"><tr><td><math alttext="a=b" display="block"><mi>a</mi></math></td></tr></table><table class="ltx_eqn_table"><tr><td><math alttext="a=b"><mi>a</mi></math></td></tr></table></div>'
    assert [e["latex"] for e in markup.equation_atoms(eq)] == ["a=b"]


def test_tex():
    tex = r"\newtheorem{thm}{Theorem}[section]\newtheorem{lemma}[thm]{Lemma}\begin{document}\section{A}Hi\begin{thm}\label{t}X\end{thm}\begin{lemma}Y\end{lemma}\begin{proof}Z\end{proof}\end{document}"
    got = [c for c in markup.tex_chunks(tex) if c["kind"] != "section"]
    assert [(c["kind"], c["label"] if c["label"] == "t" else None, c["number"]) for c in got] == [("stmt", "t", "1.1"), ("lemma", None, "1.2"), ("proof", None, "1.2")]
    assert all(tex[c["start"] : c["end"]] == c["body"] for c in markup.tex_chunks(tex))
    try:
        markup.tex_chunks(r"\begin{lemma}x")
        raise AssertionError
    except ValueError:
        pass


def test_markdown_and_pages():
    md = "# A\n\nTheorem 1. X $a\n\nb$ c.\n\nProof. Y.\n\n## B\n\nText.\n\nText."
    got = markup.markdown_chunks(md)
    assert [(c["kind"], c["section_path"]) for c in got] == [("stmt", ["A"]), ("proof", ["A"]), ("section", ["A", "B"])]
    assert "$a\n\nb$" in got[0]["body"]
    long = " ".join(f"Word number {'x' * (i % 7 + 1)}." for i in range(2000))
    assert all(markup.count_words(c) <= markup.MOST for c in markup.packed([long])) and " ".join(markup.packed([long])) == long
    pages = markup.page_chunks("Intro\n\fTheorem 2.1. A\nProof. B\n")
    assert [(c["kind"], c["page"], c["label"]) for c in pages] == [("section", 1, None), ("stmt", 2, "2.1"), ("proof", 2, "2.1")]


def test_macros():
    got = {m["symbol"]: m["expansion"] for m in markup.macros("\\newcommand{\\R}{\\mathbb{R}}\n% \\newcommand{\\no}{x}\n\\DeclareMathOperator*{\\Hom}{Hom}\\def\\a#1{b{c}}\\let\\x=\\y\\newcommand\\broken{")}
    assert got == {"\\R": "\\mathbb{R}", "\\Hom": "Hom", "\\a": "b{c}", "\\x": "\\y"}
    assert markup.lean_declarations("theorem foo : True\n-- theorem bar\n/- lemma c -/ def d := 1") == ["foo", "d"]
