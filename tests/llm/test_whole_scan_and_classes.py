"""Near-duplicate classes and scans where a bound would leave rows or words out."""

from quillon.llm import neardup, scan
from tests.llm.helpers import crowded
from tests.llm.test_algorithms import book


def test_every_key_has_a_class(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [("l1", long), ("l2", long), ("a", "Short one"), ("b", "short, ONE!"), ("c", "short two"), ("four", "w0 w1 w2 w3"), ("zh1", "这是一个句子"), ("zh2", "这是一个句子"), ("zh3", "别的句子")]
    data += [("p1", "--- !"), ("p2", "---  !"), ("p3", "?"), ("n1", None), ("n2", None), ("e", ""), ("s", " \n"), ("r", None), ("r", "short one"), (None, "short one")]
    df = crowded(spark.createDataFrame(data + data[:4], "key string, text string").selectExpr("'s' AS scope", "*"))
    got = [(r["key"], r["class_id"], r["links"]) for r in neardup.NearDuplicates(df, "scope", "key", "text").classes().collect()]
    want = [("l1", "l1", 1), ("l2", "l1", 1), ("a", "a", 2), ("b", "a", 2), ("r", "a", 2), ("c", "c", 0), ("four", "four", 0), ("zh1", "zh1", 1), ("zh2", "zh1", 1), ("zh3", "zh3", 0), ("p1", "p1", 1), ("p2", "p1", 1), ("p3", "p3", 0)]
    assert sorted(got) == sorted(want + [(k, k, 0) for k in ("n1", "n2", "e", "s")])


def test_wrong_forms_that_born_digital_text_holds_are_judged(spark):
    """Fifty places in born-digital text exempt no word in a corpus in which its repair is far more common.

    That a scanner reads t for f is learned from other words.
    """
    clean, scanned, _ = book(3)
    clean += [(f"g{i}", "after before field form function proof " * 60, False) for i in range(20)]
    scanned += [("y", "atter betore the tield or torm of\na tunction, see proot", True, 9)]
    data = [(k, t, s, None, None) for k, t, s in clean] + [(k, t, s, p, p + 1) for k, t, s, p in scanned]
    data += [(f"f{i}", "for " * 400, False, None, None) for i in range(100)] + [("t", "tor " * 60, False, None, None), ("x", "we write it tor all of them\nand for some", True, 5, 6)]
    df = spark.createDataFrame(data, "chunk_id string, body_text string, scanned boolean, page_start int, page_end int").selectExpr("*", "'b' AS book")
    kept, scan.PRINTED_WORDS = scan.PRINTED_WORDS, 2_000
    try:
        s = scan.Scan(df, "chunk_id", "body_text", "scanned", "book", "page_start", "page_end")
    finally:
        scan.PRINTED_WORDS = kept
    fixes = {r["word"]: r["fixed"] for r in s.fixes.collect()}
    assert fixes.get("tor") == "for" and "for" not in fixes
    assert ("x", 12, "misread") in {tuple(r) for r in s.defects.collect()}


def test_a_rare_misreading_is_learned_in_a_large_corpus(spark):
    """Ten thousand other words that only scanned text has don't outvote five with vv for w."""
    printed = ["twice", "lower", "follows", "shown", "nowhere"]
    rows = [(w, 1000, 0) for w in printed] + [(w.replace("w", "vv"), 0, 10) for w in printed] + [(f"{i:05d}".translate(str.maketrans("0123456789", "zxkjqvwyhg")) * 2, 0, 1) for i in range(10_000)]
    s = scan.Scan.__new__(scan.Scan)
    s.words = spark.createDataFrame(rows, "word string, digital long, scanned long")
    assert "w" in s._misreadings().get("vv", ())
