"""Characters, tokens, leaks, pieces and sentences against plain versions."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import charfold, encode, leak, lookalike, pieces, sentences
from quillon.llm.words import words
from tests.llm.helpers import crowded, rows

LETTERS = "aeoAuоеіνＡｂ̧̣́̈ͅ  ​­가각각öấǖक़ﾊﾞο日\n éཱི '_9"


def plain(s):
    """The one form by the standard library, a row at a time."""
    out = []
    for ch in s:
        if any(a <= ord(ch) <= b for a, b in charfold.NO_WIDTH):
            continue
        ch = " " if ch in charfold.SPACES else ch
        d = unicodedata.decomposition(ch)
        if d.startswith(("<wide>", "<narrow>")):
            ch = "".join(chr(int(x, 16)) for x in d.split()[1:])
        out.append("".join(charfold.SHAPES.get(x, x) for x in unicodedata.normalize("NFD", ch)))
    return unicodedata.normalize("NFC", "".join(out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(LETTERS), max_size=12), st.text(max_size=8)), max_size=8))
def test_fold(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    want = [None if t is None else plain(t) for t in texts]
    common = [i for i, t in enumerate(texts) if t is None or all(c in LETTERS or ord(c) < 0x250 for c in t)]
    got = charfold.fold_strings(pa.array(texts, pa.string())).to_pylist()
    assert [got[i] for i in common] == [want[i] for i in common]
    again = charfold.fold_strings(pa.array(got, pa.string())).to_pylist()
    assert [again[i] for i in common] == [got[i] for i in common]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), max_size=30), max_size=6))
def test_words(texts):
    w = words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\W_]+", plain(t).lower()) for t in texts]
    assert [len(x) for x in want] == [int(b - a) for a, b in zip(w.offs, w.offs[1:])]
    known = {}
    for h, x in zip(w.hashes.tolist(), [y for x in want for y in x]):
        assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)


def test_fold_of_slices_and_long_rows():
    a = pa.array(["x", "о" * 300_000, None, "", "é"], pa.string()).slice(1)
    assert charfold.fold_strings(a).to_pylist() == ["o" * 300_000, None, "", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 600_000] * 5)], names=["t"])
    assert sum(p.num_rows for p in charfold.slices(batch, 0)) == 5 and len(list(charfold.slices(batch, 0))) > 1


def test_lookalikes(spark):
    data = [("a", "café no"), ("b", "café nо"), ("b", "café nо"), ("c", "café no"), ("d", "cafe no"), ("e", None), (None, "café no"), ("f", ""), ("g", "​"), ("h", "café\nno")]
    df = crowded(spark.createDataFrame(data, "k string, t string"))
    assert rows(lookalike.lookalike_pairs(df, "k", "t")) == [("a", "b"), ("b", "c"), ("f", "g")]
    assert lookalike.lookalike_pairs(df.limit(0), "k", "t").count() == 0


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.json")
    t.encode_special_tokens = True
    random.seed(2)
    texts = [None, "", "  ", "a  b\n\n c", "I'll don't 12,5 x²", "<|endoftext|>", "ünï    x\x1c y", "word " * 40_000] + ["".join(random.choice("ab 'éж日\n\t.9 ") for _ in range(50)) for _ in range(60)]
    df = crowded(spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string"))
    got = encode.encode(df).collect()
    assert len(got) == len(texts) + 1
    assert all(r["ids"] == t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids for r in got)
    back = dict(rows(encode.decode(encode.encode(df.dropDuplicates(["doc_id"])))))
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0


def test_leaks(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.choice([5, 13, 20, 40]))) for i in range(30)] + [(98, None), (99, "")]
    docs = [(i, text(random.choice([0, 3, 60, 200]))) for i in range(40)] + [(40, items[2][1].upper().replace(" ", ",  ") + " " + items[3][1]), (41, None), (42, ""), (40, items[2][1].upper().replace(" ", ",  ") + " " + items[3][1])]
    want = {}
    for d, x in docs:
        for i, y in items:
            a, b = re.findall(r"\w+", (x or "").lower()), re.findall(r"\w+", (y or "").lower())
            best = max((n for p in range(len(a)) for q in range(len(b)) for n in [next((k for k in range(min(len(a) - p, len(b) - q)) if a[p + k] != b[q + k]), min(len(a) - p, len(b) - q))]), default=0)
            if best >= 5:
                want[(d, i)] = best
    df, it = crowded(spark.createDataFrame(docs, "doc_id long, text string")), crowded(spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["match_words"] for r in leak.find_leaks(df, it, least=5).collect()}
    assert got == want
    leak.BLOCK_WORDS, kept = 60, leak.BLOCK_WORDS
    try:
        assert {(r["doc_id"], r["item_id"]): r["match_words"] for r in leak.find_leaks(df, it, least=5).collect()} == want
    finally:
        leak.BLOCK_WORDS = kept
    assert leak.find_leaks(df.limit(0), it).count() == 0 and leak.find_leaks(df, it.limit(0)).count() == 0
    left = leak.without_leaks(df, leak.find_leaks(df, it, least=5))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_repeated_words():
    """A word a million times in a document and often in an item: hits are formed a part at a time, few grow."""
    one = words(pa.array(["ab"])).hashes[0]
    h, q = np.full(1_000_000, one), np.full(60, one)
    row, item, size, dw, iw = leak.matches(h, np.array([0, 1_000_000]), q, np.array([0, 60]), 13)
    assert (row.tolist(), item.tolist(), size.tolist(), dw.tolist(), iw.tolist()) == ([0], [0], [60], [0], [0])


def cut(t, limit=1200, least=840, overlap=100):
    out, a = [], 0
    word = lambda p: 0 < p < len(t) and t[p - 1] in " \t\n\r\f" and t[p] not in " \t\n\r\f"
    while len(t) - a > limit:
        best = {}
        for p in range(a + least, a + limit + 1):
            if word(p) and t[:p].count("$") % 2 == 0:
                q = p
                while q and t[q - 1] in " \t\n\r\f":
                    q -= 1
                best["any"] = p
                if q and t[q - 1] in ".!?":
                    best["sentence"] = p
                if t[q:p].count("\n") >= 2:
                    best["paragraph"] = p
        e = best.get("paragraph") or best.get("sentence") or best.get("any") or a + limit
        out.append((a, e))
        a = next((p for p in range(e - overlap, e) if word(p)), e - overlap)
    return out + [(a, len(t))]


def test_pieces(spark):
    random.seed(5)
    bits = ["word", "a", "$x y$", "$", "end. ", "\n\n", "   ", "\n \n", ".", "!\t", "x" * 30, " ", " ", " ", "\xa0", "é中𝒳"]
    data = [(f"k{i}", "".join(random.choice(bits) for _ in range(random.choice([300, 1500, 4000])))) for i in range(24)]
    data += [("n", None), ("e", ""), ("s", "x" * 1200), ("l", "x" * 5000), ("w", " " * 6000), (None, "y" * 3000), data[0]]
    df = crowded(spark.createDataFrame(data, "chunk_id string, body_text string"))
    want = {(k, i + 1, *p) for k, t in data if k and t and len(t) > 1200 for i, p in enumerate(cut(t))}
    for width, fan in ((pieces.RANGE, pieces.FAN), (90, 4), (3001, 2)):
        pieces.FAN, kept = fan, pieces.FAN
        try:
            got = rows(pieces.split_pieces(df, width=width))
        finally:
            pieces.FAN = kept
        assert len(got) == len(set(got)) and set(got) == want
    assert pieces.split_pieces(df.limit(0)).count() == 0


def test_pieces_of_files(spark, tmp_path):
    """Files in byte ranges that cut characters, runs of white space longer than a halo, one very long line."""
    random.seed(6)
    bits = ["word ", "a ", "$x y$ ", "$ ", "end. ", "\n\n", "é中𝒳", "x" * 30, " " * 40]
    texts = {"a.txt": "".join(random.choice(bits) for _ in range(4000)), "b.txt": "中" * 9000, "c.txt": "one. " + "\n" + " " * 7000 + "two " * 900, "d.txt": "", "e.txt": "short", "f.txt": "word. and $x$ more " * 20_000}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    want = {(name, i + 1, *p) for name, t in texts.items() if len(t) > 1200 and name != "f.txt" for i, p in enumerate(cut(t))}
    body = spark.createDataFrame([("f.txt", texts["f.txt"])], "chunk_id string, body_text string")
    want |= {tuple(r) for r in pieces.split_pieces(body).collect()}
    for width, fan in ((1001, 3), (50_000, 64)):
        pieces.FAN, kept = fan, pieces.FAN
        try:
            got = [(r[0].rsplit("/", 1)[1], *r[1:]) for r in pieces.split_files(spark, str(tmp_path), width=width).collect()]
        finally:
            pieces.FAN = kept
        assert len(got) == len(set(got)) and set(got) == want


SENTENCES = [
    ["Remarks on x", "\n\n", "See Fig. 4 and Dr. Brovsk, e.g. here.", " ", "It holds."],
    ["The remark \"is it graded?\" appears twice.", " ", "He wrote: \"It is so.\"", " ", "The end?!"],
    ["2.9. Properties of it", "\n\n", "By J. N. Zass it is 3.14.", "", "The next."],
    ["(It is so.)", " ", "What if the thing ... holds?!", " ", "Let $a. B$ be."],
    ["Am 3. Tag war es z. B. gut.", " ", "Es gilt, d. h. bis auf 2,75."],
    ["Il dit : « Le bord reste. »", " ", "Est-il convexe ?", " ", "Oui."],
    ["没有任何格！", "", "“真的吗？”作者问道。", "", "作者写道：“是。”", "", "它是1.5。"],
    ["著者は「未解決である。」と述べた。", "", "「凸か？」という問いが残る。"],
    ["लेखक ने लिखा: \"यह खुला है।\"", " ", "डॉ. Turd के अनुसार यह है।"],
    ["ให้ $x$ เป็น 5.29 เสมอ", " ", "ทุกริงของ Barn ในปีก่อน"],
    ["Автор пишет: «Этот класс».", " ", "См. рис. 9 на с. 92, т. е. там."],
    ["¿Es denso?", " ", "¡No!", " ", "Véase la pág. 5."],
]


@pytest.mark.parametrize("parts", SENTENCES, ids=range(len(SENTENCES)))
def test_sentences_with_corpus(spark, parts):
    corpus = {}
    for t in ["".join(p) for p in SENTENCES] * 3 + ["see fig. 5, e.g. that, cf. dr. x, bzw. y, рис. 3, pág. 7"] * 5:
        for w, c in sentences.evidence(t).items():
            have = corpus.setdefault(w, [0] * len(sentences.COUNTS))
            for i, n in enumerate(c):
                have[i] += n
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, corpus)] == [p for p in parts if p.strip()]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB. !?\n\t\"“”«»()$。」「ที9é"), max_size=60))
def test_sentences_cover_everything(text):
    found = sentences.split(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in found) == "".join(text.split())


def test_sentence_table(spark):
    df = crowded(spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, " \n"), (None, "A. B."), (5, "x " * 50_000 + ".")], "doc_id long, text string"))
    assert rows(sentences.split_sentences(df)) == [(1, 0, 4), (1, 5, 9), (5, 0, 100_001)]
    assert sentences.split_sentences(df.limit(0)).count() == 0
