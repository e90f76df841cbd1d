"""Problem 9: the sentences of texts in any language and script.

Document-centred disambiguation: whether a word before a full stop is an abbreviation, and whether a capitalised word
after one is a name or the start of a sentence, is settled by unambiguous occurrences elsewhere in the same document;
where it has none, by those in the whole corpus. Marks, quotation marks and white space follow rules of each script.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import materialize

MATH = "\ue000"
BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n|\Z)")
# End marks by kind, and quotation marks and brackets that may follow one.
STOPS, STRONG, WIDE = ".．", "!?！？。｡।॥", "。｡！？।॥"
OPEN_CLOSE = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‘": "’", "《": "》", "【": "】"}
BRACKETS = ")]）］】"
QUOTES = '"”»」』’》'
MARK = re.compile(r"[.．!?！？。｡।॥…]+")
TOKEN = re.compile(r"[^\s.．,;:!?！？。｡।॥…，；：、()（）\[\]\"“”„«»「」『』¿¡" + MATH + r"]+(?:[.．](?=[^\W\d_])[^\s.．,;:!?…()\"”»\]]{1,2}(?=[.．]))*")
NUMBER = re.compile(r"[v§]?\d+(?:[.,]\d+)*\Z")
LEADING = "\"“„«»(（[¿¡'‘「『"
# German words before which a number with a full stop is an ordinal.
ORDINAL_BEFORE = {"am", "vom", "zum", "im", "beim", "der", "dem", "den", "des", "das", "die", "ab", "bis", "seit"}
# Titles, known as abbreviations where neither document nor corpus tells.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "st", "hrn", "fr", "mme", "sr", "sra", "डॉ", "проф"}
COUNTS = ("abbr", "stop", "bare", "upper", "start", "middle", "low")


def masked(text: str) -> str:
    """The text with formulas between dollar signs blotted out, places unchanged. A dollar without a partner stays."""
    if "$" not in text:
        return text
    out, at = [], 0
    for stop in [m.start() for m in BLANK_LINE.finditer(text)] + [len(text)]:
        part = text[at:stop]
        pieces = part.split("$")
        pairs = (len(pieces) - 1) // 2 * 2
        for i, x in enumerate(pieces):
            if i:
                out.append(MATH if i <= pairs else "$")
            out.append(MATH * len(x) if i % 2 and i < pairs + 1 and i <= pairs else x)
        at = stop
    return "".join(out)


def paragraphs(text: str):
    """(start, end) of the stretches between blank lines, without white space at their ends."""
    at = 0
    while at < len(text):
        m = BLANK_LINE.search(text, at)
        end = m.start() if m else len(text)
        body = text[at:end]
        if body.strip():
            yield at + len(body) - len(body.lstrip()), at + len(body.rstrip())
        at = max(end + 1, at + 1) if m else len(text)


def caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


def adic(word: str) -> bool:
    """A word that starts a sentence in lower case: a single letter and a hyphen."""
    return len(word) > 2 and word[1] == "-" and word[0].isalpha()


def evidence(text: str) -> dict[str, list[int]]:
    """Counts of unambiguous occurrences by word, as COUNTS says.

    abbr: with a full stop and then a lower-case letter, digit or comma; stop: with a full stop; bare: without; upper:
    with a full stop and then a capital; start: at the start of a paragraph or after ! or ?; middle: capitalised after a
    lower-case word; low: in lower case.
    """
    out: dict[str, list[int]] = defaultdict(lambda: [0] * len(COUNTS))
    body = masked(text)
    for a, b in paragraphs(body):
        part, last = body[a:b], None
        found = list(TOKEN.finditer(part))
        for i, m in enumerate(found):
            word, end = m[0], m.end()
            if not word[0].isalpha():
                last = m
                continue
            between = part[last.end() : m.start()] if last else None
            after = part[end : end + 1]
            lower = word.lower()
            if after and after in STOPS and part[end + 1 : end + 2] not in STOPS:
                rest = part[end + 1 :].lstrip()
                out[lower][1] += 1
                follow = found[i + 1][0] if i + 1 < len(found) else ""
                if rest[:1].isdigit() and part[end + 1 : end + 2].isspace() or rest[:1] in (",", ";", ":") or rest[:1].islower() and part[end + 1 : end + 2].isspace() and not adic(follow):
                    out[lower][0] += 1
                elif not rest or rest[0].isupper():
                    out[lower][3] += 1
            else:
                out[lower][2] += 1
            if between is None or between.strip() and between.strip()[-1] in "!?":
                out[word][4] += 1
            elif word[0].isupper() and not between.strip() and last[0][0].islower():
                out[word][5] += 1
            if word[0].islower():
                out[word][6] += 1
            last = m
    return out


def needed(text: str) -> set[str]:
    """Words whose counts a document may ask for: those before and after full stops."""
    body, out = masked(text), set()
    found = list(TOKEN.finditer(body))
    for i, m in enumerate(found):
        if body[m.end() : m.end() + 1] in ("", ".", "．") and m[0][0].isalpha():
            out.add(m[0].lower())
        if i and any(c in STOPS for c in body[found[i - 1].end() : m.start()]) or i and found[i - 1][0][-1] in STOPS:
            out |= {m[0], m[0].lower()}
    return out


class Judge:
    """Decisions of one document: its own evidence first, the corpus where it has none."""

    def __init__(self, own: dict[str, list[int]], corpus: dict[str, list[int]]):
        self.own, self.corpus, self.none = own, corpus, [0] * len(COUNTS)

    def abbreviation(self, word: str) -> bool:
        if len(word) == 1 or "." in word[:-1]:
            return True
        w = word.lower()
        for c in (self.own.get(w, self.none), self.corpus.get(w, self.none)):
            abbr, stop, bare = c[0], c[1], c[2]
            if bare > 2 * stop:
                return False
            if abbr and abbr * 5 >= stop:
                return bare * 4 <= stop
        # short, frequent and never without its full stop
        return stop >= 5 and bare * 20 <= stop and len(word) <= 5 or w in TITLES

    def ends(self, word: str) -> bool:
        """Whether an abbreviation more often ends a sentence than not."""
        c = self.corpus.get(word.lower(), self.own.get(word.lower(), self.none))
        return c[3] * 2 > c[1]

    def starter(self, word: str) -> bool:
        """Whether a capitalised word is a common one that starts sentences, and no name."""
        for table in (self.own, self.corpus):
            c, low = table.get(word, self.none), table.get(word.lower(), self.none)[6]
            if c[4] >= 2 and (c[4] > (2 if low else 4) * c[5] and (low or c[4] > 3) or low > c[5]):
                return True
            if low > 3 * (c[5] + 1) and not c[5]:
                return True
            if c[5] > c[4]:
                return False
        return False


def breaks(part: str, judge: Judge) -> list[int]:
    """Places in a masked paragraph where a sentence ends."""
    out = []
    stack: list[tuple[str, int]] = []
    at = 0
    straight = None
    for m in MARK.finditer(part):
        if m.start() < at:
            continue
        for p in range(at, m.start()):  # quotation marks and brackets that are open here
            c = part[p]
            if c == '"':
                if straight is None:
                    straight = p
                else:
                    straight = None
            elif stack and c == OPEN_CLOSE[stack[-1][0]]:
                stack.pop()
            elif c in OPEN_CLOSE:
                stack.append((c, p))
        k, opener, quoted = m.end(), None, False
        while k < len(part):
            c = part[k]
            if c == '"' and straight is not None:
                opener, straight, quoted, k = straight, None, True, k + 1
            elif stack and c == OPEN_CLOSE[stack[-1][0]]:
                o, opener_at = stack.pop()
                if c not in BRACKETS:
                    opener, quoted = opener_at, True
                k += 1
            elif c.isspace() and stack and stack[-1][0] == "«" and part[k : k + 40].lstrip()[:1] == "»":
                opener, quoted = stack.pop()[1], True
                k = part.index("»", k) + 1
            else:
                break
        at = k
        if _ends(part, m.start(), m.end(), k, opener if quoted else None, judge):
            out.append(k)
    return out


def _ends(part: str, i: int, j: int, k: int, opener: int | None, judge: Judge) -> bool:
    lead = UNSEEN.match(part, k)
    nxt = part[lead.end() : lead.end() + 200]
    if not nxt:
        return False  # the end of the paragraph is one anyway
    c, space, marks = nxt[0], any(x.isspace() for x in lead[0]), part[i:j]
    first = TOKEN.match(nxt)
    word = first[0] if first else ""
    if c in ",;:，、；：)]）】" or c in STOPS or c in STRONG:
        return False
    strong = any(x in STRONG for x in marks)
    if opener is not None:
        if c.islower() and not adic(word):
            return False
        before = part[max(0, opener - 40) : opener].rstrip()
        if caseless(c) or any(x in WIDE for x in marks):
            return before[-1:] in (":", "：")
        if strong or c.isupper():
            return True
    if any(x in WIDE for x in marks):
        return not (c.islower() and marks[-1] in "！？" and not adic(word))
    if strong:
        return not c.islower() or adic(word)
    if k > j and not strong:  # a closed bracket or quotation after a full stop
        return not c.islower() or adic(word)
    if len(marks) > 1 or "…" in marks:
        return not c.islower() and not c.isdigit() or adic(word)
    # one full stop
    start = i
    while start > 0 and not part[start - 1].isspace() and part[start - 1] != MATH:
        start -= 1
    token = part[start:i].lstrip(LEADING)
    formula = start > 0 and part[start - 1] == MATH and not token
    tail = re.split(r"[(（\"“„«\[/—–]", token)[-1]
    if not space and k == j:
        if c.isdigit() or c.islower():
            return False
        if c.isupper() and nxt[1:2] in STOPS:
            return False
    if not token and not formula:
        return not c.islower()
    if formula:
        return not c.islower() or adic(word)
    if NUMBER.match(tail):
        if start == 0:
            return False
        if c.islower():
            return adic(word)
        if c.isdigit():
            return space and "." in tail
        previous = re.findall(r"\w+", part[max(0, start - 40) : start])[-1:] or [""]
        return not (c.isupper() and tail.isdigit() and len(tail) <= 2 and previous[0].lower() in ORDINAL_BEFORE and not judge.starter(word))
    # the part after the last bare stop counts too: in "e.g" that is a single letter
    if "." in tail and not tail[-1:].isdigit():
        inner = tail.split(".")
        if all(len(x) <= 2 for x in inner):
            tail = "x.x"
        else:
            tail = inner[-1]
    if judge.abbreviation(tail):
        if c.islower():
            return adic(word) and judge.ends(tail)
        if c.isdigit():
            return False
        if c.isupper():  # a single letter with a full stop is an initial, so a name begins
            return not (len(word) == 1 and nxt[1:2] in STOPS) and judge.starter(word)
        return judge.ends(tail)
    if c.islower():
        return adic(word)
    return True


# white space and characters without width
UNSEEN = re.compile(r"[\s\u00ad\u200b-\u200d\u2060\ufeff]*")
THAI_SPACE = re.compile(r"(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])")


def split(text: str, corpus: dict[str, list[int]] | None = None) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end); together they cover all that is not white space."""
    body = masked(text)
    judge, out = Judge(evidence(text), corpus or {}), []
    for a, b in paragraphs(body):
        part = body[a:b]
        ends = set(breaks(part, judge)) | {m.start() for m in THAI_SPACE.finditer(part)}
        at = 0
        for e in sorted(ends) + [len(part)]:
            piece = part[at:e]
            if piece.strip():
                out.append((a + at + len(piece) - len(piece.lstrip()), a + at + len(piece.rstrip())))
            at = e
    return out


def _evidence(batches):
    total: dict[str, list[int]] = {}
    for batch in batches:
        for text in batch.column(1).to_pylist():
            for w, c in evidence(text).items():
                have = total.setdefault(w, [0] * len(COUNTS))
                for i, n in enumerate(c):
                    have[i] += n
        if len(total) > 200_000:
            yield _counts(total)
            total = {}
    if total:
        yield _counts(total)


def _counts(total):
    return pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([c[i] for c in total.values()], pa.int64()) for i in range(len(COUNTS)))], names=["word", *COUNTS])


def _needed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(needed(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "words"])


def _split(batches):
    for batch in batches:
        ids, starts, ends = [], [], []
        words, texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        for i, (text, known) in enumerate(zip(texts, words)):
            corpus = {k["word"]: [k[c] for c in COUNTS] for k in known or ()}
            found = split(text, corpus)
            ids += [i] * len(found)
            starts += [s for s, _ in found]
            ends += [e for _, e in found]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "sent_start", "sent_end"])


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of every text; offsets in characters from 0, ends exclusive.

    Null, empty and blank texts and null keys have no sentence; repeated rows of a key count once (of several texts the
    least). The corpus counts are made over all texts; each document gets those of its own doubtful words by a join.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    counts = docs.mapInArrow(_evidence, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    asked = docs.mapInArrow(_needed, "doc_id long, words array<string>").select("doc_id", F.explode("words").alias("word"))
    known = asked.join(materialize(counts), "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", *COUNTS)).alias("known"))
    return docs.join(known, "doc_id", "left").select("doc_id", "text", "known").mapInArrow(_split, "doc_id long, sent_start int, sent_end int")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_sentences(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {"p9_found": p9_found}
