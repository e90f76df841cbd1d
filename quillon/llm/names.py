"""Problem 5: variant spellings of names, linked to a registry of persons or of named results.

Trie join: the words of the registered names are kept in tries, a Levenshtein automaton walks a trie for each distinct
word of the typed names and enumerates the registered words within one edit (a swap of neighbours is one), and the
parts of a name are then tried in every order.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import charfold
from quillon.session import materialize

#: Registered names of one trie; a larger registry is searched trie by trie.
SHARD_NAMES = 50_000
#: Edits that one word may carry, and the least length of a word that may carry one.
EDITS, LEAST_LENGTH = 1, 4
# Short forms of given names.
SHORT = {
    "gabi": "gabriela", "gaby": "gabriela", "bill": "william", "billy": "william", "will": "william", "lupe": "guadalupe",
    "lupita": "guadalupe", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "dick": "richard", "rick": "richard",
    "rich": "richard", "nacho": "ignacio", "hans": "johannes", "vova": "vladimir", "volodya": "vladimir", "bastian": "sebastian",
    "seb": "sebastian", "bob": "robert", "rob": "robert", "bobby": "robert", "misha": "mikhail", "seun": "oluwaseun",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "poldi": "leopold", "leo": "leopold", "sasha": "alexander",
    "alex": "alexander", "sascha": "alexander", "betty": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "eliza": "elizabeth",
    "etta": "henrietta", "hettie": "henrietta", "kolya": "nikolai", "chica": "francesca", "fran": "francesca", "cesca": "francesca",
    "mitya": "dmitri", "dima": "dmitri", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "mina": "wilhelmina",
    "minna": "wilhelmina", "pasha": "pavel", "uli": "ulrike", "tom": "tomas", "jim": "james", "jack": "john", "mike": "michael",
}
# Kinds of statement by their abbreviations.
KINDS = {
    "lemma": "lemma", "lem": "lemma", "inequality": "inequality", "ineq": "inequality", "correspondence": "correspondence",
    "corr": "correspondence", "criterion": "criterion", "crit": "criterion", "theorem": "theorem", "thm": "theorem",
    "conjecture": "conjecture", "conj": "conjecture", "principle": "principle", "princ": "principle", "formula": "formula",
    "form": "formula", "proposition": "proposition", "prop": "proposition", "corollary": "corollary", "cor": "corollary",
    "identity": "identity", "problem": "problem",
}
FILLERS = {"the", "of", "and", "s", "a", "an", "by"}
# Letters without a decomposition, and TeX commands for letters.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "ł": "l", "Ł": "L", "đ": "d", "ı": "i"})
TEX_LETTERS = {"o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "ae": "æ", "ss": "ß", "i": "i", "j": "j"}
TEX_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "v": "\u030c", "u": "\u0306", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a"}
_MARK = re.compile(r"""\\(["'`^~=.]|[vuHckr](?=[{\s]))\s*\{?\\?([^\W\d_])\}?""")
_LETTER = re.compile(r"\{?\\(aa|AA|ae|ss|[oOlLij])(?![^\W\d_])\s*\}?")
WORD = re.compile(r"[^\W\d_]+")


def clean(name: str) -> str:
    """TeX accents resolved and composed; case and accents stay. The name is in its one character form already."""
    if "\\" in name:
        name = _LETTER.sub(lambda m: TEX_LETTERS[m[1]], name)
        name = _MARK.sub(lambda m: m[2] + TEX_MARKS[m[1]], name)
    return unicodedata.normalize("NFC", name.replace("{", "").replace("}", ""))


def plain(word: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.translate(LETTERS).lower()) if not unicodedata.combining(c))


class Trie:
    """Words by their letters; ``near`` walks it with the rows of an edit-distance automaton."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.near = functools.lru_cache(200_000)(self._near)

    def _near(self, word: str, bound: int) -> tuple[tuple[str, int], ...]:
        out, n = [], len(word)
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, above = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= bound:
                        out.append((child, row[n]))
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                    if above and j > 1 and word[j - 2] == c and word[j - 1] == last:
                        d = min(d, above[j - 2] + 1)
                    new.append(d)
                if min(new) <= bound or min(row) <= bound - 1:
                    stack.append((child, c, new, row))
        return tuple(sorted(out))

    def find(self, word: str) -> tuple[tuple[str, int], ...]:
        """Registered words that ``word`` may stand for: itself if it is one, else those one edit away."""
        got = self.near(word, EDITS if len(word) >= LEAST_LENGTH else 0)
        exact = tuple(x for x in got if x[1] == 0)
        return exact or got


class Persons:
    """Given name, initials, last word of the name: which registered person a typed name means."""

    def __init__(self, registry: list[tuple[int, str]], short: dict[str, str] = SHORT):
        self.short = short
        self.people: dict[str, list[tuple]] = {}
        given = set()
        for i, name in registry:
            parts = WORD.findall(clean(name))
            if len(parts) < 2:
                continue
            first, middle, last = plain(parts[0]), [plain(x)[0] for x in parts[1:-1]], plain(parts[-1])
            given.add(first)
            self.people.setdefault(last, []).append((i, first, middle, unicodedata.normalize("NFC", parts[0])[0].lower()))
        self.given = given | set(short) | set(short.values())
        self.last, self.first = Trie(self.people), Trie(self.given)

    def _first(self, typed: str, raw: str, person: tuple) -> float | None:
        """The cost of ``typed`` for the person's given name, None if it is another one."""
        _, first, _, letter = person
        if len(typed) == 1:
            return None if typed != first[0] else 0.3 if raw.lower() == letter else 0.5
        if typed == first or self.short.get(typed) == first:
            return 0.0
        if typed in self.given:
            return None
        return next((float(d) for w, d in self.first.find(typed) if w == first or self.short.get(w) == first), None)

    def match(self, name: str) -> list[tuple[int, float]]:
        """(entity, cost) of the cheapest ones."""
        words = [(plain(w), w) for w in WORD.findall(clean(name))]
        found: dict[int, float] = {}
        if len(words) > 4:  # a last name and three other parts are the most that can match
            return []
        for at, (word, _) in enumerate(words):
            if len(word) < 3:
                continue
            rest = []
            for p, w in words[:at] + words[at + 1 :]:
                # two letters that are no name are two initials
                rest += [(p[0], w[0]), (p[1], w[1])] if len(p) == 2 and len(w) == 2 and p not in self.given else [(p, w)]
            if not 1 <= len(rest) <= 3:
                continue
            for last, edits in self.last.find(word):
                for person in self.people[last]:
                    for order in itertools.permutations(rest):
                        # initials keep the order they were typed in
                        ones = [x for x in order if len(x[0]) == 1]
                        if len(ones) > 1 and ones != [x for x in rest if len(x[0]) == 1]:
                            continue
                        cost = self._first(*order[0], person)
                        middle = [p for p, _ in order[1:]]
                        if cost is None or any(len(m) > 1 for m in middle) or middle and middle != person[2]:
                            continue
                        cost += edits + (0.2 if person[2] and not middle else 0)
                        found[person[0]] = min(cost, found.get(person[0], 9))
        least = min(found.values(), default=0)
        return sorted((i, float(c)) for i, c in found.items() if c == least)


class Results:
    """Names of persons, words in between, kind of statement: which registered result a typed name means."""

    def __init__(self, registry: list[tuple[int, str]], kinds: dict[str, str] = KINDS):
        self.kinds = kinds
        self.entries, by = [], {}
        for i, name in registry:
            parts = clean(name)
            people = [plain(w) for w in WORD.findall(parts.split(" ")[0])]
            words = [plain(w) for w in WORD.findall(parts)]
            kind = kinds.get(words[-1]) if words else None
            if kind is None:
                continue
            for p in people:
                by.setdefault(p, []).append(len(self.entries))
            self.entries.append((i, people, words[len(people) : -1], kind))
        self.by, self.trie = by, Trie(by)
        self.longest = max((len(p) + len(b) + 1 for _, p, b, _ in self.entries), default=0)

    def match(self, name: str) -> list[tuple[int, float]]:
        """(entity, cost) of the cheapest ones."""
        words = [w for w in (plain(w) for w in WORD.findall(clean(name))) if w not in FILLERS]
        found: dict[int, int] = {}
        if len(words) > self.longest:  # every word has to be accounted for
            return []
        for word in words:
            for near, _ in self.trie.find(word) if len(word) > 2 else ():
                for at in self.by[near]:
                    i, people, between, kind = self.entries[at]
                    cost = self._cost(words, people, between, kind)
                    if cost is not None:
                        found[i] = min(cost, found.get(i, 9))
        least = min(found.values(), default=0)
        return sorted((i, float(c)) for i, c in found.items() if c == least)

    def _cost(self, words, people, between, kind):
        left, cost = list(words), 0
        for p in people:
            got = min(((d, w) for w in left if len(w) > 2 for x, d in self.trie.find(w) if x == p), default=None)
            if got is None:
                return None
            cost += got[0]
            left.remove(got[1])
        named = [w for w in left if self.kinds.get(w) == kind]
        if not named:
            return None
        left.remove(named[-1])
        if left and left != between:
            if len(left) != len(between) or any(w != b and not Trie([b]).near(w, 1) for w, b in zip(left, between)):
                return None
            cost += 1
        return cost if left or not between else cost + 0.5


MATCHERS = {"persons": Persons, "results": Results}


#: Distinct typed names of one task.
TASK_NAMES = 5_000


def link_names(names: DataFrame, registry: DataFrame, kind: str, name: str, entity: str, entity_name: str, forms: dict[str, str] | None = None) -> DataFrame:
    """(name, entity_id) of each distinct typed name that means a registered entity; ``kind``: ``persons`` or ``results``.

    A name that means none, is empty or null, or means two equally well has no row. The registry goes to the workers in
    shards of SHARD_NAMES names, whatever its size; of all shards' answers the cheapest counts, so shards change nothing.
    ``forms``: short forms of given names, or abbreviations of kinds of statement, to the full ones (SHORT, KINDS).
    """
    spark = names.sparkSession
    typed = materialize(names.select(F.col(name).cast("string").alias("name")).where("name IS NOT NULL AND length(name) > 0").distinct())
    typed = typed.repartition(max(1, -(-typed.count() // TASK_NAMES)), "name")  # by rows: a name costs far more than its bytes
    schema, found, shard = "name string, entity_id long, cost double", [], []
    given = {} if forms is None else {"short" if kind == "persons" else "kinds": forms}

    def one(rows):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches):
            match = MATCHERS[kind](sent.value, **given).match
            for b in batches:
                raw = b.column(0)
                best = [match(n) if n else [] for n in charfold.fold_strings(raw).to_pylist()]
                at = pa.array([i for i, x in enumerate(best) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([raw.take(at), pa.array([i for x in best for i, _ in x], pa.int64()), pa.array([c for x in best for _, c in x], pa.float64())], names=["name", "entity_id", "cost"])

        return typed.mapInArrow(run, schema)

    known = registry.select(F.col(entity).cast("long").alias("i"), F.col(entity_name).alias("n")).where("i IS NOT NULL AND n IS NOT NULL").distinct()
    for r in known.toLocalIterator():
        shard.append((r["i"], charfold.fold_strings(pa.array([r["n"]])).to_pylist()[0]))
        if len(shard) >= SHARD_NAMES:
            found.append(one(shard))
            shard = []
    if shard or not found:
        found.append(one(shard))
    all_ = functools.reduce(DataFrame.unionByName, found)
    # the least and the greatest of the cheapest: one entity if they are the same
    ends = all_.groupBy("name").agg(F.min(F.struct("cost", "entity_id")).alias("a"), F.min(F.struct("cost", (-F.col("entity_id")).alias("entity_id"))).alias("b"))
    return ends.where("a.entity_id = -b.entity_id").select("name", "a.entity_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    authors = read("paper_metadata").select(F.lit("paper_metadata").alias("record_set"), F.col("paper_id").alias("record_key"), F.posexplode(F.from_json("authors", "array<string>")).alias("name_pos", "name"))
    titles = read("theorem_names").select(F.lit("theorem_names").alias("record_set"), F.col("dedup_key").alias("record_key"), F.lit(0).alias("name_pos"), F.col("display_name").alias("name"))
    people = link_names(authors, read("author_registry"), "persons", "name", "author_id", "full_name")
    results = link_names(titles, read("named_results"), "results", "name", "result_id", "canonical_name")
    out = authors.join(people, "name").unionByName(titles.join(results, "name"))
    return out.where("record_key IS NOT NULL").select("record_set", "record_key", "name_pos", "entity_id").distinct()


QUERIES = {"p5_found": p5_found}
