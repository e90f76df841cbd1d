"""Problem 6: traces of the scanned page in text, and continuous paragraphs made of it.

Two averaged perceptrons, trained here. One takes lines for page furniture by their place on the page. The other is a
character editor: for a character it predicts keep, replace, delete, insert, or join, which deletes a mark at a line end
and joins the lines. What a scanner reads for what is learned from the corpus: words that only scanned text has are
aligned with words of born-digital text, and what is no more common among words that only born-digital text has is no
misreading. Counts of words and lines are made over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.perceptron import AveragedPerceptron
from quillon.session import broadcast_if_small, materialize

#: Bounds of what is trained on: lines, words, hyphenated words. Everything else covers all rows.
TRAIN_LINES, TRAIN_WORDS = 20_000, 2_000
#: Words of born-digital text up to which a word counts as printed by the number of times it is seen.
PRINTED_WORDS = 2_000_000
#: Misread words that may be broadcast (some 20 MB); more are joined by shuffle.
MOST_FIXES = 200_000
# Marks of a word broken at a line end.
MARKS = "-‐¬­"
#: Misreadings are learned from at least so many words that only scanned text has, and so many times as many as born-digital
#: text has; characters on a side.
LEAST_SUPPORT, LEAST_RATIO, SPAN = 4, 3.0, 2
OPERATIONS = ["keep", "replace", "delete", "insert", "join"]
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
FORMULA = re.compile(r"\$[^$]*\$")
BROKEN = re.compile(rf"[^\W_]+[{MARKS}][ \t]*\n\s*\S*")
NUMBER_LINE = re.compile(r"[\[\]\-–—|·. ]*(?:(?:page|seite|p\.|s\.)\s*)?(\d+|(?=[ivxlc])(?:xc|xl|l?x{0,3}|c{1,3}(?:xc|xl|l?x{0,3}))(?:ix|iv|v?i{0,3}))[\[\]\-–—|· ]*\Z", re.I)


def bucket(n: float) -> int:
    return int(log2(n + 1))


def blotted(text: str) -> str:
    """The text with formulas between dollar signs blotted out by spaces; places stay."""
    return FORMULA.sub(lambda m: re.sub(r"[^\n\f]", " ", m[0]), text) if "$" in text else text


# ---- lines -------------------------------------------------------------------------------------------------


def lines(text: str) -> list[tuple[int, str, bool]]:
    """(place of the first non-blank character, the line without blanks at its ends, whether a form feed comes before)."""
    out, at = [], 0
    for raw in text.split("\n"):
        feed = "\f" in raw
        body = raw.replace("\f", " ")
        out.append((at + len(body) - len(body.lstrip()), body.strip(), feed))
        at += len(raw) + 1
    return out


def line_key(line: str) -> str:
    """A line without its digits, case and spacing: what recurs on every page."""
    return re.sub(r"[\d\s]+", " ", line).strip().lower()


def page_edges(found: list[tuple[int, str, bool]], first: int | None, last: int | None) -> tuple[list, list, list]:
    """For each line: its number if it is nothing but one; whether it begins or ends with a number of its page; whether
    a form feed or a lone number is next to it."""
    alone = [NUMBER_LINE.match(x) if x else None for _, x, _ in found]
    full = [i for i, (_, x, _) in enumerate(found) if x]
    place = {i: n for n, i in enumerate(full)}

    def paged(n: str) -> bool:
        return n.isdigit() and first is not None and int(first) <= int(n) <= int(last if last is not None else first) + 1

    numbers, seams = [], []
    for i, (_, line, feed) in enumerate(found):
        if not line:
            numbers.append(None), seams.append(False)
            continue
        m = alone[i] or re.match(r"(\d+)\s", line) or re.search(r"\s(\d+)\Z", line)
        numbers.append(None if m is None else paged(m[1]))
        n = place[i]
        before, after = full[n - 1] if n else None, full[n + 1] if n + 1 < len(full) else None
        seams.append(feed or before is not None and alone[before] is not None or after is not None and (found[after][2] or alone[after] is not None))
    return alone, numbers, seams


def line_features(found: list[tuple[int, str, bool]], text: str, counts: dict[int, tuple[int, int]], first: int | None, last: int | None) -> list[tuple]:
    """Features of each line of a text; ``counts``: how often each line number's key recurs in its book, and at page edges."""
    sizes = sorted(len(x) for _, x, _ in found if x)
    usual = sizes[len(sizes) // 2] if sizes else 0
    alone, numbers, seams = page_edges(found, first, last)
    out, before = [], None
    for i, (at, line, feed) in enumerate(found):
        letters = [c for c in line if c.isalpha()]
        start = text.rfind("\n", 0, at) + 1
        n, edge = counts.get(i, (1, 0))
        share = "few" if n < 3 else "edge" if edge >= 0.8 * n else "mixed" if edge >= 0.4 * n else "inside"
        f = [
            "bias",
            f"recur{min(bucket(n), 6)}",
            f"share{share}",
            f"alone{alone[i] is not None}{numbers[i] if alone[i] else ''}",
            f"bracket{line.startswith('(')}",
            f"number{numbers[i]}",
            f"feed{feed}",
            f"seam{seams[i]}",
            f"caps{bool(letters) and all(c.isupper() for c in letters)}",
            f"indent{min(3, (at - start) // 4)}",
            f"end{line[-1:] in '.!?,;:'}",
            f"mark{line[-1:] in MARKS}",
            f"short{bool(usual) and len(line) * 10 < usual * 9}",
            f"math{'$' in line}",
            f"chapter{bool(re.match(r'(chapter|kapitel)?[ ]*[0-9]+[.] ', line, re.I))}",
            f"open{before is not None and found[before][1][-1:] not in '.!?:'}",
            f"words{min(len(line.split()), 8)}",
            f"lower{line[:1].islower()}",
            f"letters{min(4, len(letters) // 4)}",
        ]
        f += [f"{f[a]}&{f[b]}" for a, b in ((1, 7), (2, 7), (5, 7), (3, 4), (8, 7), (9, 7), (17, 7), (2, 10), (2, 13), (10, 7), (5, 10), (11, 7))] + [f"{f[9]}&{f[7]}&{f[12]}", f"{f[2]}&{f[7]}&{f[10]}&{f[12]}"]
        out.append(tuple(f))
        if line:
            before = i
    return out


def line_seed(line: str, features: tuple) -> str | None:
    """The kind of a line where its features leave no doubt: what the line model is trained on."""
    has = set(features)
    if not line:
        return None
    if "bracketTrue" in has:
        return "text"
    if "aloneTrueTrue" in has or "aloneTrueFalse" in has and "seamTrue" in has:
        return "page_no"
    if "aloneFalse" not in has:
        return None
    if "mathTrue" in has or "endTrue" in has or "markTrue" in has or "shareinside" in has or "seamFalse" in has and "numberTrue" not in has:
        return "text"
    if "shareedge" in has:
        return "header"
    return "text" if "sharefew" in has and "shortFalse" in has and "numberTrue" not in has and "capsFalse" in has else None


def small(batches, rows: int = 400):
    """Batches of few rows: what is made of one is many times as large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _line_rows(batches):
    for b in small(batches):
        ids, no, slug, keys, edge = [], [], [], [], []
        for k, s, text, first, last in zip(*(b.column(i).to_pylist() for i in range(5))):
            found = lines(text)
            _, numbers, seams = page_edges(found, first, last)
            for i, (_, line, _) in enumerate(found):
                if line:
                    ids.append(k), no.append(i), slug.append(s or ""), keys.append(line_key(line)), edge.append(int(seams[i] or bool(numbers[i])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(no, pa.int32()), pa.array(slug, pa.string()), pa.array(keys, pa.string()), pa.array(edge, pa.int32())], names=["chunk_id", "no", "slug", "key", "edge"])


# ---- words and marks ---------------------------------------------------------------------------------------


def frames(word: str) -> list[tuple[str, str]]:
    """(the word with up to SPAN neighbouring characters left out, those characters), for every place."""
    n = len(word)
    return [(f"{word[:i]}\0{word[j:]}", word[i:j]) for i in range(n + 1) for j in range(i, min(n, i + SPAN) + 1) if n - (j - i) >= 3]


def repairs(word: str, rules: dict[str, list[str]], many: bool = False) -> list[tuple[str, tuple[tuple[int, str, str], ...]]]:
    """(repaired word, edits as (place, what was read, what is printed)): one edit, or (``many``) two that don't touch."""
    if len(word) < 3 or word.isdigit():
        return []
    single = [(i, word[i : i + k], printed) for i in range(len(word) + 1) for k in range(SPAN + 1) if i + k <= len(word) for printed in rules.get(word[i : i + k], ())]

    def apply(edits):
        out, at = [], 0
        for i, read, printed in edits:
            out += [word[at:i], printed]
            at = i + len(read)
        return "".join(out) + word[at:]

    chosen = [p for p in combinations(single, 2) if p[0][0] + len(p[0][1]) < p[1][0]] if many else [(e,) for e in single]
    return [(apply(p), p) for p in chosen]


def spoil(word: str, at: int, rules: dict[str, list[str]]) -> list[str]:
    """What a scanner may read for the word, misreading what stands at or after ``at``, as the rules say."""
    out = []
    for i in (*range(at, len(word)), *range(at)):
        out += [word[:i] + read + word[i + len(printed) :] for read, all_ in rules.items() for printed in all_ if printed and word.startswith(printed, i)]
    return out


def operations(edits) -> list[tuple[int, str, str, str]]:
    """(place, character, operation, what it becomes) of each character that the edits touch."""
    out = []
    for i, read, printed in edits:
        for k, c in enumerate(read):
            if k >= len(printed):
                out.append((i + k, c, "delete", ""))
            elif k == len(read) - 1 and len(printed) > len(read):
                out.append((i + k, c, "insert", printed[k:]))
            elif c != printed[k]:
                out.append((i + k, c, "replace", printed[k]))
        if not read:
            out.append((max(0, i - 1), "", "insert", printed))
    return out


def edits_of(row: dict) -> list[tuple[int, str, str]]:
    return [(i, *rule.split(">")) for i, rule in zip(row["places"], row["reads"])]


def edit_features(word: str, own: tuple[int, int], fixed: str, known: tuple[int, int], edits) -> list[tuple[tuple, str]]:
    """(features, operation) of each character that a repair touches; counts are (in born-digital rows, in scanned rows)."""
    have, want = sum(own), sum(known)
    ratio = max(-2, min(14, int(log2((want + 1) / (have + 1)))))
    digit = digit_between(word, edits)
    f = [
        "bias", f"want{min(bucket(want), 10)}", f"have{min(bucket(have), 8)}", f"ratio{ratio}", f"digital{own[0] > 0}", f"clean{known[0] > 0}",
        f"digit{digit}", f"edits{len(edits)}", f"size{min(len(word), 8)}", f"ratio{ratio}&size{min(len(word), 6)}", f"ratio{ratio}&edits{len(edits)}",
        f"ratio{ratio}&digital{own[0] > 0}", f"digit{digit}&want{want > 0}&digital{own[0] > 0}",
    ]
    for i, r, p in edits:
        f += [f"rule{r}>{p}", f"rule{r}>{p}&ratio{ratio}"]
    return [((*f, f"char{c}>{to}", f"near{word[max(0, i - 1) : i]}{c}{word[i + 1 : i + 2]}"), op) for i, c, op, to in operations(edits)]


def digit_between(word: str, edits) -> bool:
    """Whether all edits turn a digit that has letters beside it into letters."""
    return all(r.isdigit() and p.isalpha() and (word[:i][-1:].isalpha() or word[i + 1 : i + 2].isalpha()) for i, r, p in edits)


def mark_features(mark: str, joined: int, kept: int, left: int, right: int, lower: bool) -> tuple:
    f = [
        "bias", f"mark{mark}", f"joined{min(bucket(joined), 8)}", f"kept{min(bucket(kept), 8)}", f"left{min(bucket(left), 6)}", f"right{min(bucket(right), 6)}",
        f"more{(joined > kept) - (joined < kept)}", f"lower{lower}", f"parts{left > 0}{right > 0}",
    ]
    return tuple(f + [f"{f[1]}&{f[6]}", f"{f[2]}&{f[3]}", f"{f[6]}&{f[8]}", f"{f[1]}&{f[8]}"])


def _count_words(batches):
    total: dict[str, list[int]] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([c[0] for c in total.values()], pa.int64()), pa.array([c[1] for c in total.values()], pa.int64())], names=["word", "digital", "scanned"])

    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, scanned in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if scanned:
                text = BROKEN.sub(" ", text)
            seen[scanned].update(COMPOUND.findall(FORMULA.sub(" ", text)))
        for i in (0, 1):
            for w, n in seen[i].items():
                total.setdefault(w, [0, 0])[i] += n
                if "-" in w:
                    for part in w.split("-"):
                        total.setdefault(part, [0, 0])[i] += n
        if len(total) > 200_000:
            yield out()
            total.clear()
    if total:
        yield out()


_FOUND = "chunk_id string, char_start int, kind string, mark string, word string, cut int, left string, right string, lower boolean, after int"


def _scan_page(model: dict, classes: list[str]):
    """Kinds of lines; then marks at line ends and words of the running text, a row each."""

    def run(batches):
        page = AveragedPerceptron(classes)
        page.weights = model
        for b in small(batches):
            rows = []
            for k, text, first, last, recur in zip(*(b.column(i).to_pylist() for i in range(5))):
                counts = {x["no"]: (x["n"], x["edges"]) for x in recur or ()}
                found = lines(text)
                feats = line_features(found, text, counts, first, last)
                kinds = [page.predict(f) if line else "blank" for (_, line, _), f in zip(found, feats)]
                chars = list(blotted(text))
                for (at, line, _), kind in zip(found, kinds):
                    if kind in ("header", "page_no"):
                        rows.append((k, at, kind, None, None, None, None, None, None, None))
                        chars[at : at + len(line)] = " " * len(line)
                body = "".join(chars)
                inside = set()
                for m in re.finditer(rf"([^\W_]+)([{MARKS}])[ \t]*\n[\s]*([^\W_]+)", body):
                    left, mark, right = m[1], m[2], m[3]
                    rows.append((k, m.start(2), "mark", mark, left + right, len(left), left, right, right[:1].islower(), m.start(3)))
                    inside |= {m.start(1), m.start(3)}
                for m in WORD.finditer(body):
                    if len(m[0]) > 2 and m.start() not in inside and not m[0].isdigit():
                        rows.append((k, m.start(), "word", None, m[0], None, None, None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _frame_rows(batches):
    for b in small(batches):
        rows = [(i, frame, piece) for i, w in enumerate(b.column(0).to_pylist()) for frame, piece in frames(w)]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "read", "frame", "piece"])


_REPAIR = "word string, fixed string, places array<int>, reads array<string>, digit boolean"


def _repair_rows(rules: dict[str, list[str]], many: bool):
    def run(batches):
        for b in batches:
            for w in b.column(0).to_pylist():
                found = repairs(w, rules, many)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(found)), pa.array([x for x, _ in found]), pa.array([[e[0] for e in p] for _, p in found], pa.list_(pa.int32())), pa.array([[f"{r}>{x}" for _, r, x in p] for _, p in found], pa.list_(pa.string())), pa.array([digit_between(w, p) for _, p in found])], names=["word", "fixed", "places", "reads", "digit"])

    return run


def _judge(model: dict):
    """Rows (word, own counts, fixed, its counts, edits) to those that the character editor makes, with their score."""

    def run(batches):
        editor = AveragedPerceptron(OPERATIONS)
        editor.weights = model
        for b in batches:
            ok, score = [], []
            for r in b.to_pylist():
                sum_ = 0.0
                for features, op in edit_features(r["word"], (r["digital"], r["scanned"]), r["fixed"], (r["fd"], r["fs"]), edits_of(r)):
                    s = editor.scores(features)
                    gain = s[OPERATIONS.index(op)] - s[0]
                    sum_ = sum_ + gain if gain > 0 and sum_ is not None else None
                ok.append(bool(sum_))
                score.append(sum_ or 0.0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(6), pa.array(score, pa.float64())], names=["word", "fixed", "places", "score"]).filter(keep)

    return run


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the key. No task sends more than its share of about 2 n rows."""
    total = df.count()
    return df.where(F.pmod(F.xxhash64(key), F.lit(max(1, total))) < 2 * n).orderBy(F.xxhash64(key), key).limit(n)


class Scan:
    """Defects of scanned pages in a table of texts.

    ``defects``: (chunk_id, char_start, defect) as ``p6_found`` wants them; ``fixes``: (word, fixed) of misread words.
    Rows that aren't ``scanned`` (a boolean column) only lend their words. Null texts and keys take no part, repeated rows
    of a key count once (of several texts the least). Other columns are ignored; a null book is a book of its own.
    """

    def __init__(self, df: DataFrame, key: str, text: str, scanned: str, book: str, first: str, last: str):
        rows = df.select(F.col(key).cast("string").alias("chunk_id"), F.col(text).alias("body"), F.coalesce(F.col(scanned), F.lit(False)).alias("scanned"), F.col(book).cast("string").alias("slug"), F.col(first).cast("int").alias("first"), F.col(last).cast("int").alias("last")).where("chunk_id IS NOT NULL AND body IS NOT NULL")
        self.words = materialize(rows.select("body", "scanned").mapInArrow(_count_words, "word string, digital long, scanned long").groupBy("word").agg(F.sum("digital").alias("digital"), F.sum("scanned").alias("scanned")))
        pages = rows.where("scanned").groupBy("chunk_id").agg(F.min(F.struct("body", "slug", "first", "last")).alias("r")).select("chunk_id", "r.*")
        self.pages = materialize(pages)
        shown = self.pages.select("chunk_id", "slug", "body", "first", "last").mapInArrow(_line_rows, "chunk_id string, no int, slug string, key string, edge int")
        recur = shown.groupBy("slug", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("edge").alias("edges")).where("n > 1")
        marked = shown.join(recur, ["slug", "key"]).groupBy("chunk_id").agg(F.collect_list(F.struct("no", "n", "edges")).alias("recur"))
        placed = materialize(self.pages.join(marked, "chunk_id", "left").select("chunk_id", "body", "first", "last", "recur"))
        self.page_model = self._train_lines(placed)
        self.found = materialize(placed.mapInArrow(_scan_page(self.page_model.weights, self.page_model.classes), _FOUND))
        self.rules = self._misreadings()
        self.editor = AveragedPerceptron(OPERATIONS).fit(sorted(self._taught_words() + self._taught_marks())).weights
        self.marks = materialize(self._marks())
        self.fixes = materialize(self._fixes())
        self.defects = self._defects()

    def _train_lines(self, placed: DataFrame) -> AveragedPerceptron:
        """Trained on the lines without doubt of the texts with the least hashes, TRAIN_LINES at most."""
        train, kinds = [], Counter()
        for r in sample(placed, "chunk_id", TRAIN_LINES // 10).collect():
            found = lines(r["body"])
            feats = line_features(found, r["body"], {x["no"]: (x["n"], x["edges"]) for x in r["recur"] or ()}, r["first"], r["last"])
            for (_, line, _), f in zip(found, feats):
                kind = line_seed(line, f)
                if kind and (kind != "text" or kinds["text"] < TRAIN_LINES // 2) and len(train) < TRAIN_LINES:
                    kinds[kind] += 1
                    train.append((f, kind))
        return AveragedPerceptron(["text", "header", "page_no"]).fit(train)

    def _printed(self, least: int) -> DataFrame:
        """Words of the born-digital rows that may be taught as printed: seen ``least`` times, in a corpus of more than
        PRINTED_WORDS words in proportion, so that a rare wrong form isn't taught where there is more text."""
        total = self.words.agg(F.sum("digital")).head()[0] or 0
        return self.words.where(F.col("digital") >= least * max(1.0, total / PRINTED_WORDS))

    def _counted(self, table: DataFrame, column: str, digital: str, scanned: str) -> DataFrame:
        known = self.words.select(F.col("word").alias(column), F.col("digital").alias(digital), F.col("scanned").alias(scanned))
        return table.join(known, column, "left").na.fill(0, [digital, scanned])

    def _mark_counts(self, table: DataFrame) -> DataFrame:
        """(word, kept, left, right) with their counts in all rows."""
        for c in ("word", "kept", "left", "right"):
            known = self.words.select(F.col("word").alias(c), (F.col("digital") + F.col("scanned")).alias(f"n_{c}"))
            table = table.join(known, c, "left").na.fill(0, [f"n_{c}"])
        return table

    def _misreadings(self) -> dict[str, list[str]]:
        """What is read to what may be printed, learned from all words of the corpus.

        Words of one side only that differ from a common printed word in one place of at most SPAN characters are aligned
        with it. A misreading is supported by words that only scanned text has, and LEAST_RATIO times as often as by words
        that only born-digital text has, in proportion to their numbers: endings and the like are as common there. A word
        supports the most common of its misreadings only, so an ending with a misread letter is none. The support that is
        asked for does not grow with the corpus: the words that have a rare pair of letters don't either.
        """
        plain = self.words.where("length(word) > 3 AND NOT word RLIKE '-'")
        printed = self._printed(5).where("length(word) > 3 AND NOT word RLIKE '[0-9-]'").select("word", (F.col("digital") + F.col("scanned")).alias("total"))
        odd = plain.where("digital = 0 OR scanned = 0").select("word", (F.col("digital") == 0).alias("read"), (F.col("digital") + F.col("scanned")).alias("own"))
        framed = lambda t: t.mapInArrow(_frame_rows, "word string, n long, read boolean, frame string, piece string")
        right = framed(printed.select("word", F.col("total").alias("n"), F.lit(False).alias("read"))).select("frame", F.col("word").alias("other"), F.col("piece").alias("to"), F.col("n").alias("total"))
        left = framed(odd.select("word", F.col("own").alias("n"), "read")).withColumnRenamed("n", "own")
        # nothing common at either end belongs to the misreading
        pair = left.hint("merge").join(right, "frame")  # a word has many frames: neither side is small
        pair = pair.where("total >= 8 * own AND word <> other").where("piece <> to AND NOT (length(piece) > 0 AND length(to) > 0 AND (left(piece, 1) = left(to, 1) OR right(piece, 1) = right(to, 1)))")
        pair = materialize(pair.where("lower(piece) <> lower(to)").select("word", "read", "piece", "to").distinct())
        count = pair.groupBy("piece", "to").agg(F.count_if("read").alias("scan"), F.count_if(~F.col("read")).alias("digital"))
        sizes = {r["read"]: r["count"] for r in odd.groupBy("read").count().collect()}
        share = max(1, sizes.get(True, 0)) / max(1, sizes.get(False, 0), sizes.get(True, 0))
        likely = materialize(count.where((F.col("scan") >= LEAST_SUPPORT) & (F.col("scan") >= LEAST_RATIO * share * F.col("digital"))).select("piece", "to", "scan"))
        told = pair.where("read").join(broadcast_if_small(likely), ["piece", "to"]).groupBy("word").agg(F.max_by(F.struct("piece", "to"), F.struct("scan", "piece", "to")).alias("r"))
        kept = told.groupBy("r.piece", "r.to").count().where(F.col("count") >= LEAST_SUPPORT).orderBy("piece", "to")
        rules: dict[str, list[str]] = {}
        for r in kept.collect():  # pairs of pieces of two characters of an alphabet
            # shapes that are mistaken one way may be mistaken the other way
            for read, to in ((r["piece"], r["to"]), (r["to"], r["piece"])):
                if to not in rules.setdefault(read, []) and (read and to or (read, to) == (r["piece"], r["to"])):
                    rules[read].append(to)
        return {k: sorted(v) for k, v in sorted(rules.items()) if v}

    def _taught_words(self) -> list[tuple[tuple, str]]:
        """Characters of TRAIN_WORDS printed words, spoiled and not, with what the editor has to do."""
        chosen = sample(self._printed(10).where("length(word) > 2 AND NOT word RLIKE '-'"), "word", TRAIN_WORDS)
        rules, schema = self.rules, "word string, fixed string, places array<int>, reads array<string>, label string"

        def teach(batches):
            for b in batches:
                for w in b.column(0).to_pylist():
                    rows = [(w, x, p, "keep") for x, p in repairs(w, rules)]
                    for x in spoil(w, hash_of(w) % len(w), rules)[:4] if w.isalpha() else ():
                        rows += [(x, w, p, "edit") for fixed, p in repairs(x, rules) if fixed == w]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([[e[0] for e in r[2]] for r in rows], pa.list_(pa.int32())), pa.array([[f"{e[1]}>{e[2]}" for e in r[2]] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], names=["word", "fixed", "places", "reads", "label"])

        table = materialize(materialize(chosen.select("word")).mapInArrow(teach, schema))
        known = self._counted(self._counted(table, "word", "digital", "scanned"), "fixed", "fd", "fs")
        # of repairs that lead to no known word an eighth is enough
        known = known.where("label = 'edit' OR fd + fs > 0 OR pmod(xxhash64(fixed), 8) = 0 OR exists(reads, r -> r RLIKE '[0-9]')")
        train = []
        for r in known.collect():
            edits, own, want = edits_of(r), (r["digital"], r["scanned"]), (r["fd"], r["fs"])
            if r["label"] == "edit":
                if own[0]:  # the spoiled form is a word itself
                    continue
                train += edit_features(r["word"], own, r["fixed"], want, edits)
                if digit_between(r["word"], edits):  # as if the word stood nowhere else
                    train += edit_features(r["word"], own, r["fixed"], (0, 0), edits)
            else:
                train += [(f, "keep") for f, _ in edit_features(r["word"], own, r["fixed"], want, edits)]
        return train

    def _taught_marks(self) -> list[tuple[tuple, str]]:
        """Marks of printed words broken at a line end, to be joined, and of words written with a hyphen, to be kept."""
        train, parts = [], []
        chosen = sample(self._printed(5).where("length(word) > 5"), "word", TRAIN_WORDS)
        for r in chosen.select("word").collect():
            w = r["word"]
            if "-" in w:
                parts += [(w.replace("-", "", 1), w, *w.split("-", 1), "keep")] * 3
            elif w.isalpha():
                cut = 2 + hash_of(w) % (len(w) - 4)
                parts.append((w, f"{w[:cut]}-{w[cut:]}", w[:cut], w[cut:], "join"))
        if parts:
            table = self._mark_counts(self.words.sparkSession.createDataFrame(parts, "word string, kept string, left string, right string, label string"))
            for r in table.collect():
                for mark in MARKS if r["label"] == "join" else "-":
                    train.append((mark_features(mark, r["n_word"], r["n_kept"], r["n_left"], r["n_right"], r["right"][:1].islower()), r["label"]))
        return train

    def _marks(self) -> DataFrame:
        """The marks at line ends that are deleted: (chunk_id, char_start, word, cut, left, after)."""
        model = self.editor

        def decide(batches):
            judge = AveragedPerceptron(OPERATIONS)
            judge.weights = model
            for b in batches:
                ok = [r["lower"] and judge.predict(mark_features(r["mark"], r["n_word"], r["n_kept"], r["n_left"], r["n_right"], r["lower"])) == "join" for r in b.to_pylist()]
                yield b.select(["chunk_id", "char_start", "word", "cut", "left", "after"]).filter(pa.array(ok, pa.bool_()))

        at = self.found.where("kind = 'mark'").select("chunk_id", "char_start", "mark", "word", "cut", "left", "right", "lower", "after", F.concat_ws("-", "left", "right").alias("kept"))
        return self._mark_counts(at).mapInArrow(decide, "chunk_id string, char_start int, word string, cut int, left string, after int")

    def _fixes(self) -> DataFrame:
        """(word, fixed, places) of the distinct words that the character editor changes.

        A word has to become one that the corpus knows, unless only digits between letters change. Two edits are tried
        where one doesn't do and born-digital text hasn't the word.
        """
        types = self.found.where("kind = 'word'").select("word").union(self.marks.select("word"))
        # both halves of a word whose mark stays are words by themselves
        halves = self.found.where("kind = 'mark'").join(self.marks.select("chunk_id", "char_start"), ["chunk_id", "char_start"], "left_anti").select(F.explode(F.array("left", "right")).alias("word"))
        own = materialize(self._counted(types.union(halves).distinct(), "word", "digital", "scanned"))
        known = self.words.select(F.col("word").alias("fixed"), F.col("digital").alias("fd"), F.col("scanned").alias("fs"))

        def judged(rows: DataFrame, many: bool) -> DataFrame:
            tried = rows.select("word").mapInArrow(_repair_rows(self.rules, many), _REPAIR).hint("merge").join(known, "fixed", "left").where("fd IS NOT NULL OR digit").na.fill(0, ["fd", "fs"]).join(rows, "word")
            made = tried.select("word", "digital", "scanned", "fixed", "fd", "fs", "places", "reads").mapInArrow(_judge(self.editor), "word string, fixed string, places array<int>, score double")
            return materialize(made.groupBy("word").agg(F.max_by(F.struct("fixed", "places"), F.struct("score", "fixed")).alias("b")).select("word", "b.fixed", "b.places"))

        one = judged(own, False)
        return one.unionByName(judged(own.where("digital = 0").join(one, "word", "left_anti"), True))

    def _defects(self) -> DataFrame:
        fixes = broadcast_if_small(self.fixes, MOST_FIXES)
        furniture = self.found.where("kind IN ('header', 'page_no')").select("chunk_id", "char_start", F.col("kind").alias("defect"))
        hyphens = self.marks.select("chunk_id", "char_start", F.lit("hyphen").alias("defect"))
        plain = self.found.where("kind = 'word'").select("chunk_id", "char_start", "word").join(fixes.select("word"), "word").select("chunk_id", "char_start", F.lit("misread").alias("defect"))
        # of a broken word, the part that holds the misread character
        part = self.marks.join(fixes.select("word", F.element_at("places", 1).alias("at")), "word").select("chunk_id", F.when(F.col("at") < F.col("cut"), F.col("char_start") - F.col("cut")).otherwise(F.col("after")).cast("int").alias("char_start"), F.lit("misread").alias("defect"))
        stays = self.found.where("kind = 'mark'").join(self.marks.select("chunk_id", "char_start"), ["chunk_id", "char_start"], "left_anti")
        stays = stays.select("chunk_id", F.explode(F.array(F.struct((F.col("char_start") - F.col("cut")).alias("char_start"), F.col("left").alias("word")), F.struct(F.col("after").alias("char_start"), F.col("right").alias("word")))).alias("h")).select("chunk_id", "h.char_start", "h.word")
        part = part.unionByName(stays.join(fixes.select("word"), "word").select("chunk_id", "char_start", F.lit("misread").alias("defect")))
        return furniture.unionByName(hyphens).unionByName(plain).unionByName(part).distinct()

    def paragraphs(self) -> DataFrame:
        """(chunk_id, text): the repaired texts: furniture removed, lines joined, misread words replaced, a blank line
        between paragraphs."""
        fixes = self.fixes.where("fixed <> word").select("word", "fixed")
        words = self.found.where("kind = 'word'").select("chunk_id", "char_start", "word").join(broadcast_if_small(fixes, MOST_FIXES), "word")
        joins = self.marks.join(broadcast_if_small(fixes, MOST_FIXES), "word", "left")
        edits = (
            words.select("chunk_id", "char_start", F.lit("word").alias("kind"), "word", "fixed")
            .unionByName(joins.select("chunk_id", F.col("char_start") - F.col("cut"), F.lit("join").alias("kind"), F.col("left").alias("word"), F.coalesce("fixed", "word").alias("fixed")).toDF("chunk_id", "char_start", "kind", "word", "fixed"))
            .unionByName(self.found.where("kind IN ('header', 'page_no')").select("chunk_id", "char_start", F.lit("line").alias("kind"), F.lit("").alias("word"), F.lit("").alias("fixed")))
        )
        listed = edits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "kind", "word", "fixed"))).alias("edits"))

        def repair(batches):
            for b in batches:
                out = [repaired(text, edits or []) for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["chunk_id", "text"])

        return self.pages.select("chunk_id", "body").join(listed, "chunk_id", "left").mapInArrow(repair, "chunk_id string, text string")


def hash_of(word: str) -> int:
    """A hash that is the same in every process."""
    out = 0
    for c in word:
        out = (out * 1_000_003 + ord(c)) & 0x7FFFFFFF
    return out


def repaired(text: str, edits: list[dict]) -> str:
    """The text with its edits applied from the end, as paragraphs of one line each."""
    for e in sorted(edits, key=lambda e: -e["char_start"]):
        at = e["char_start"]
        if e["kind"] == "line":
            end = text.find("\n", at)
            start = text.rfind("\n", 0, at) + 1
            text = text[:start] + text[(len(text) if end < 0 else end + 1) :]
        elif e["kind"] == "word":
            text = text[:at] + e["fixed"] + text[at + len(e["word"]) :]
        else:
            tail = re.compile(r"[^\W_]+.[ \t]*[\s\f]*[^\W_]+", re.S).match(text, at)
            if tail:
                text = text[:at] + e["fixed"] + text[tail.end() :]
    text = re.sub(r"(?<=[^\W_]-)[ \t]*\n[ \t]*(?=[^\W_])", "", text)  # a word written with a hyphen
    return "\n\n".join(re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n[ \t\f]*\n", text) if p.strip())


def _scan(spark: SparkSession, sf: str) -> Scan:
    chunks = spark.read.parquet(f"{sf}/chunks.parquet").withColumn("scanned", F.col("source_kind") == "textbook")
    return Scan(chunks, "chunk_id", "body_text", "scanned", "textbook_slug", "page_start", "page_end")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).defects


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).paragraphs()


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
