"""Toxicity from a learned lexicon, fuzzy matching and the context of each hit."""

from __future__ import annotations

import math
from bisect import bisect_left
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import body, map_batches, written

#: Bounds of what training looks at: labelled rows (about), and lexicon terms.
TRAINING_ROWS = 30_000
LEXICON_TERMS = 600
#: A term needs so many toxic texts, and so much higher a rate among its texts than among all.
LEAST_TEXTS, LEAST_LIFT = 6, 3.0
#: Terms of at least this length also match at one edit.
FUZZY_LENGTH = 5
#: Lengths of the stems: beginnings of longer words, for languages that inflect or compound.
STEM_LENGTHS = (5, 7)
#: Words on either side of a hit that are its context.
WINDOW = 6
#: Automaton states that a task keeps.
LIVE_STATES = 5_000
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
#: Words that report speech, in the languages of the tables.
REPORTING = frozenset("said says wrote writes called calls quote quoted term word sagte schrieb nannte zitat wort dijo dice escribió llamó cita palabra dit écrit appelé citation mot".split())


def held_out() -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic as words need it.

    A state is the set of (trie node, edits so far); a word that strays from
    every term by two edits reaches the empty state within a few letters.
    Stems, marked by a final ``*``, match any word they begin.
    """

    def __init__(self, weights: dict[str, float], edits: int = 1):
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[float, bool]] = {}
        self.short: set[int] = set()
        for term, weight in weights.items():
            node, letters = 0, term.removesuffix("*")
            path = [0]
            for c in letters:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                path.append(node)
            self.term[node] = max(self.term.get(node, (0.0, False)), (weight, term.endswith("*")))
            if len(letters) < FUZZY_LENGTH:
                self.short.add(node)
        #: States are numbered; a step leads from a number and a letter to a number, 0 being the empty state.
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers.clear()
        self.states.clear()
        self.steps.clear()
        self._number(frozenset())
        self.start = self._number(self._closed({(0, 0)}))

    def _number(self, state: frozenset[tuple[int, int]]) -> int:
        found = self.numbers.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Adds the states that a missing letter leads to."""
        open_states = list(states)
        while open_states:
            node, used = open_states.pop()
            if used < self.edits:
                for child in self.children[node].values():
                    if (child, used + 1) not in states:
                        states.add((child, used + 1))
                        open_states.append((child, used + 1))
        return frozenset(states)

    def step(self, number: int, letter: str) -> int:
        found = self.steps.get((number, letter))
        if found is None:
            after = set()
            for node, used in self.states[number]:
                child = self.children[node].get(letter)
                if child is not None:
                    after.add((child, used))
                if used < self.edits:
                    after.add((node, used + 1))
                    after.update((c, used + 1) for c in self.children[node].values())
            found = self._number(self._closed(after))
            self.steps[number, letter] = found
        return found

    def match(self, word: str) -> tuple[int, float] | None:
        """``(kind, weight)`` of the best term: kind 0 exact, 1 stem, 2 misspelt."""
        if len(self.states) > LIVE_STATES:
            self._reset()
        number, stem = self.start, None
        for letter in word:
            number = self.step(number, letter)
            if not number:
                break
            for node, used in self.states[number]:
                if used == 0 and node in self.term and self.term[node][1]:
                    stem = max(stem or 0.0, self.term[node][0])
        state = self.states[number]
        exact = [self.term[n][0] for n, used in state if used == 0 and n in self.term and not self.term[n][1]]
        if exact:
            return 0, max(exact)
        if stem is not None:
            return 1, stem
        near = [self.term[n][0] for n, used in state if used and n in self.term and n not in self.short and not self.term[n][1]]
        return (2, max(near)) if near else None


KEPT_LETTERS = 64


class Hits(dict):
    """Memo of :meth:`Automaton.match`, of a bounded size."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        found = self.automaton.match(word)
        # Overlong words are matched, which ends early, but not kept.
        if len(word) > KEPT_LETTERS:
            return found
        if len(self) > 100_000:
            self.clear()
        self[word] = found
        return found


FEATURES = ("exact", "stem", "misspelt", "quoted", "direct", "density", "weight", "strongest", "clustered", "any")


def features(text: str, hits: Hits) -> list[float]:
    """Numbers about the hits of a text; all zero without any."""
    words = TOKEN.findall(text.lower())
    found = [(i, h) for i, w in enumerate(words) if (h := hits[w])]
    if not found:
        return [0.0] * len(FEATURES)
    marks = [i for i, w in enumerate(words) if w in QUOTES]
    kinds, quoted, weight, top, clustered, last = [0, 0, 0], 0, 0.0, 0.0, 0, -1 << 30
    for i, (kind, value) in found:
        kinds[kind] += 1
        before = bisect_left(marks, i)
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        # Inside an open pair of quotation marks that closes, or beside a reporting word.
        is_quoted = (before % 2 == 1 and marks[-1] > i) or not REPORTING.isdisjoint(near)
        quoted += is_quoted
        clustered += i - last <= WINDOW
        last = i
        weight += value * (0.2 if is_quoted else 1.0)
        top = max(top, value)
    direct = len(found) - quoted
    return [
        *(math.log1p(k) for k in kinds), math.log1p(quoted), math.log1p(direct), math.log1p(100.0 * direct / len(words)),
        math.log1p(weight), top, math.log1p(clustered), 1.0 if kinds[0] else 0.0,
    ]


def training_texts(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """``text, toxic`` of about ``limit`` labelled rows at most, one of each text; no held-out row.

    Labels are cut by a hash of the id before the join, so the broadcast side
    has a bounded size. A label counts as toxic if any of its rows says so.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, limit / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Words and stems whose texts are toxic far more often than others, with shrunken log odds as weights."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    sized = F.filter(words, lambda w: F.length(w) >= 3)

    def stems(length: int) -> Column:
        return F.array_distinct(F.transform(F.filter(sized, lambda w: F.length(w) > length), lambda w: F.concat(F.substring(w, 1, length), F.lit("*"))))

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic")).first()
    if not size.toxic or size.toxic == size.n:
        return {}
    base = size.toxic / size.n
    counts = rows.select("toxic", F.explode(F.concat(sized, *[stems(n) for n in STEM_LENGTHS])).alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    rate = (F.col("bad") + base) / (F.col("n") + 1)
    odds = F.log(rate / (1.0001 - rate)) - math.log(base / (1 - base))
    excess = (F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * base + 1)
    best = counts.where((F.col("bad") >= LEAST_TEXTS) & (rate >= min(LEAST_LIFT * base, (1 + base) / 2))).select("term", odds.alias("weight"), excess.alias("z"))
    return {r.term: float(r.weight) for r in best.orderBy(F.desc("z"), "term").limit(terms).collect()}


class Scorer:
    """Lexicon and logistic weights; small enough to travel with each task."""

    def __init__(self, lexicon: dict[str, float], weights: list[float], bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def hits(self) -> Hits:
        return Hits(Automaton(self.lexicon))

    def score(self, text: str, hits: Hits) -> float:
        z = self.bias + sum(w * f for w, f in zip(self.weights, features(text, hits), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Scorer:
    """Learns the lexicon and the weights of the hit features from labelled rows that are not held out.

    Without labels of both kinds every text scores the base rate.
    """
    rows = written(training_texts(docs, labels, limit), "toxic-training")
    lexicon = learn_lexicon(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic")).first()
    if not lexicon:
        # Half a text at a tenth: without labels nothing speaks against a text.
        rate = (size.toxic + 0.05) / (size.n + 0.5)
        return Scorer({}, [0.0] * len(FEATURES), math.log(rate / (1 - rate)) if 0 < rate < 1 else 3.0)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(Automaton(lexicon))
        for batch in batches:
            found = [features(t.as_py(), hits) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["label", "found"])

    described = map_batches(rows, describe, "label double, found array<double>").select("label", array_to_vector("found").alias("features"))
    model = LogisticRegression(regParam=0.001, maxIter=60).fit(written(described.select("label", F.col("features")), "toxic-features"))
    return Scorer(lexicon, [float(w) for w in model.coefficients], float(model.intercept))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Only the text is scored. Null and empty texts, and texts without a hit,
    get the score of no evidence. A null ``doc_id`` is not held out. Repeated
    rows are reported as often as they come; other columns are ignored; an
    empty table gives none. Texts do not move: the model is sent to them.
    """
    scorer = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = scorer.hits()
        for batch in batches:
            values = [scorer.score(t.as_py(), hits) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(docs.select("doc_id", body().alias("text")), score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns; all of them where the labels teach no lexicon."""
    scorer = fit(docs, labels)
    if not scorer.lexicon:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = scorer.hits()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([scorer.score(t.as_py() or "", hits) < threshold for t in texts], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
