"""Toxicity: misspelled terms by Levenshtein automata over a lexicon trie, and context that tells abuse from quotation.

The lexicon holds a few plain terms of abuse and what labelled documents teach: words and beginnings of words that stand in
toxic documents far more often than chance allows (log-likelihood ratio, with a bound that grows with the number of terms
looked at). Beginnings matter, as inflected terms take many endings. Near copies would make any of their words look
telling, so of training documents that share the smallest of their pairs of words, by several hashes in turn, one counts. Each matched form weighs what the labels
say of it, drawn towards its term and its edits: a form that clean documents hold as an ordinary word counts for nothing.

A text is scored from its hits alone. A hit counts less between quotation marks or after words that report speech, and
more beside words for the person addressed; what counts is the strongest hit and the strongest window of words. A logistic
regression on these two turns them into a probability.

Texts meet the automaton in narrow Arrow batches; the lexicon and weights are some thousands of strings at most. Labels are
learned from a bounded sample of labelled documents.

Defined results: a null or empty text has no hits and the score of such texts; documents with repeated ids are scored
each, and a training document's label is 1 if any of its rows says so; null labels and ids teach nothing; without labels
of both classes the plain terms and fixed coefficients decide; an empty table gives an empty result; other columns pass
through, and a column named like the result is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .lexicon import Entry, LexiconAutomaton

#: Labelled documents that are learned from at most, those with the smallest hashes of their ids; terms learned at most.
TRAIN_ROWS, TERMS = 40_000, 2_000
#: Hashes by which near copies are told.
SKETCHES = 5
#: Plain terms of abuse that hold without labels.
TERMS_OF_ABUSE = ["idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "imbecile", "dummkopf", "abschaum", "trottel", "imbécile", "crétin", "ordure", "idiota", "estúpido", "imbécil", "basura"]
#: Letters of learned beginnings, toxic documents that a learned term needs, and how much likelier they must be to hold it.
SHORTEST, LONGEST, SUPPORT, LIFT = 4, 12, 4, 4.0
#: How sure a plain term is without labels, a form of one edit, and one of two; each counts as so many documents or forms.
PRIOR, PRIOR_WEIGHT = (0.97, 0.75, 0.6), 4
#: Words to either side that make a window; what a quoted hit and one beside the person addressed count.
WINDOW, QUOTED, DIRECT = 8, 0.25, 1.25
#: Coefficients without labels of both classes: of the strongest hit, of the strongest window, and the constant.
DEFAULT = (0.8, 0.8, -3.5)

WORD = re.compile(r"[^\W_](?:[\w*@$]*[^\W_])?")
QUOTES = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’")
REPORTING = set("said says say called calls call quote quoted wrote writes word words term terms sagte sagt nannte nennt wort zitat dit appelle appelé mot citation dijo dice llamó llama palabra cita".split())
ADDRESSED = set("you your you're youre du dich dein deine ihr euch tu toi ton vous votre tú vosotros usted ustedes".split())


def words_of(text: str | None) -> list[str]:
    return WORD.findall(normal(text))


def normal(text: str | None) -> str:
    """Lower case, composed; ASCII texts are so already."""
    low = (text or "").lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low)


@dataclass
class Lexicon:
    """Entries, how likely each makes a text toxic by edits, and the weights of forms that labels know."""

    entries: list[Entry]
    sure: list[float]
    fuzzy: tuple[float, float] = PRIOR[1:]
    forms: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = DEFAULT

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.entries)

    def belief(self, entry: int, edits: int) -> float:
        return self.sure[entry] if not edits else min(self.sure[entry], self.fuzzy[edits - 1])

    def weight(self, form: str, entry: int, edits: int) -> float:
        """The log-odds that a form adds."""
        known = self.forms.get(form)
        return log_odds(self.belief(entry, edits)) if known is None else known

    def score(self, strongest: float, window: float) -> float:
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a * strongest + b * window + c))))


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    form: str
    entry: int
    edits: int
    quoted: bool
    weight: float


def hits_of(text: str | None, lexicon: Lexicon, automaton: LexiconAutomaton) -> tuple[list[Hit], float, float]:
    """The hits of a text (places in its normal form), the strongest one's weight and the strongest window's."""
    low = normal(text)
    found = {w: m for w in set(WORD.findall(low)) if (m := automaton.match(w))}
    if not found:
        return [], 0.0, 0.0
    quotes = [m.span() for m in QUOTES.finditer(low)]
    words = list(WORD.finditer(low))
    hits, weights, q = [], [], 0
    for k, m in enumerate(words):
        if m[0] not in found:
            continue
        entry, edits = found[m[0]]
        while q < len(quotes) and quotes[q][1] <= m.start():
            q += 1
        near = {x[0] for x in words[max(0, k - WINDOW) : k + WINDOW + 1]}
        before = {x[0] for x in words[max(0, k - WINDOW) : k]}
        quoted = (q < len(quotes) and quotes[q][0] < m.start()) or bool(before & REPORTING)
        weight = max(0.0, lexicon.weight(m[0], entry, edits)) * (QUOTED if quoted else DIRECT if near & ADDRESSED else 1.0)
        hits.append(Hit(m.start(), m.end(), m[0], entry, edits, quoted, weight))
        weights.append((k, weight))
    best, run, first = 0.0, 0.0, 0
    for k, w in weights:
        run += w
        while weights[first][0] < k - WINDOW:
            run -= weights[first][1]
            first += 1
        best = max(best, run)
    return hits, max(w for _, w in weights), math.log1p(best)


def measured(texts: DataFrame, lexicon: Lexicon, text: str = "text") -> Column:
    """A struct of the hits, the strongest one, the strongest window and the score of a text column."""
    kept: list[LexiconAutomaton] = []

    @F.pandas_udf("hits array<struct<start int, end int, form string, term string, edits int, quoted boolean, weight double>>, strongest double, window double, score double")
    def measure(batch: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(lexicon.automaton())
        rows = []
        for t in batch:
            hits, strongest, window = hits_of(t, lexicon, kept[0])
            rows.append(([{"start": h.start, "end": h.end, "form": h.form, "term": lexicon.entries[h.entry].term, "edits": h.edits, "quoted": h.quoted, "weight": h.weight} for h in hits], strongest, window, lexicon.score(strongest, window)))
        return pd.DataFrame(rows, columns=["hits", "strongest", "window", "score"])

    return measure(F.col(f"`{text}`"))


def smallest_pair(words: Column, seed: int) -> Column:
    """The smallest hash of two neighbouring words."""
    return F.array_min(F.transform(words, lambda x, i: F.xxhash64(F.lit(seed), x, F.get(words, i + 1))))


def training_documents(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """text, words (each once) and toxic (0 or 1) of at most `rows` labelled documents; near copies of one class count once."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).na.drop().filter("toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @F.pandas_udf("array<string>")
    def words(batch: pd.Series) -> pd.Series:
        return batch.map(words_of)

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    d = d.join(F.broadcast(staged(known, "labels-learned")), "doc_id").withColumn("words", words("text"))
    least = [smallest_pair(F.col("words"), k).alias(f"like{k}") for k in range(SKETCHES)]
    d = staged(d.select("doc_id", "toxic", "text", F.array_distinct("words").alias("words"), *least), "toxicity-training")
    likes = [f"like{k}" for k in range(SKETCHES)]
    one = d.select("doc_id", "toxic", *likes)
    for like in likes:  # copies that one smallest pair tells apart share another
        one = one.groupBy("toxic", F.col(like).alias("key")).agg(F.min(F.struct("doc_id", *likes)).alias("first")).select("toxic", "first.*")
    one = one.select("doc_id", "toxic").distinct()
    return staged(d.select("doc_id", "toxic", "text", "words").join(F.broadcast(one), ["doc_id", "toxic"], "left_semi"), "toxicity-training")


def class_counts(train: DataFrame) -> tuple[int, int]:
    r = train.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    return r["t"], r["c"]


def telling_terms(train: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, int, int]]:
    """Words' beginnings with the toxic and clean documents that hold them, where chance can't explain the difference; of
    those that begin with each other only the most telling one."""
    heads = F.transform("words", lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST)))), lambda k: F.substring(w, F.lit(1), k)))
    terms = train.select("toxic", F.explode(F.array_distinct(F.flatten(heads))).alias("term")).filter(F.length("term") >= SHORTEST)
    counts = staged(terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-terms")
    t, c, all_t, all_c = F.col("t"), F.col("c"), float(n_toxic), float(n_clean)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    held, n = t + c, all_t + all_c
    ratio = 2 * (part(t, held * all_t / n) + part(c, held * all_c / n) + part(all_t - t, (n - held) * all_t / n) + part(all_c - c, (n - held) * all_c / n))
    least = 2 * math.log(max(2, counts.count())) + 6
    telling = counts.filter((t >= SUPPORT) & (t / all_t >= LIFT * c / all_c)).withColumn("g", ratio).filter(F.col("g") >= least)
    rows = telling.orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(TERMS).collect()
    taken: dict[str, tuple[str, int, int]] = {}
    begins: set[str] = set()
    for r in rows:
        x = r["term"]
        if x in begins or any(x[:k] in taken for k in range(SHORTEST, len(x) + 1)):
            continue
        taken[x] = (x, r["t"], r["c"])
        begins.update(x[:k] for k in range(1, len(x) + 1))
    return list(taken.values())


def lexicon_of(learned: Iterable[tuple[str, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Plain terms and learned ones. How sure an entry is follows from its counts, drawn towards PRIOR for plain terms and a
    half for others."""
    counts = {term: (t, c) for term, t, c in learned}
    entries = [Entry(term, True) for term in counts] + [Entry(term, False) for term in TERMS_OF_ABUSE if term not in counts]
    return Lexicon(entries, [entry_belief(counts.get(e.term), n_toxic, n_clean) for e in entries])


def entry_belief(counts: tuple[int, int] | None, n_toxic: int, n_clean: int) -> float:
    if counts is None:
        return PRIOR[0]
    return math.exp(rate := form_weight(*counts, 0.5, n_toxic, n_clean)) / (1 + math.exp(rate))


def form_weight(t: int, c: int, belief: float, n_toxic: int, n_clean: int) -> float:
    """The log of how much likelier a toxic document holds a form, with `belief` as good as PRIOR_WEIGHT documents."""
    prior = PRIOR_WEIGHT / (n_toxic + n_clean)
    return math.log((t / n_toxic + prior * belief) / (c / n_clean + prior * (1 - belief)))


def learned_forms(train: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> Lexicon:
    """`lexicon` with the weights of all forms that training documents hold, and of unknown forms by their edits."""
    kept: list[LexiconAutomaton] = []

    @F.pandas_udf("array<struct<form string, entry int, edits int>>")
    def matches(batch: pd.Series) -> pd.Series:
        if not kept:
            kept.append(lexicon.automaton())
        return batch.map(lambda words: [{"form": w, "entry": m[0], "edits": m[1]} for w in words if (m := kept[0].match(w))])

    hits = train.select("toxic", F.explode(matches("words")).alias("h")).select("toxic", "h.*")
    forms = hits.groupBy("form", "entry", "edits").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    believed = []
    for edits in (1, 2):
        here = [r for r in forms if r["edits"] == edits]
        bad = sum(r["t"] / n_toxic > r["c"] / n_clean for r in here)
        believed.append((bad + PRIOR_WEIGHT * PRIOR[edits]) / (len(here) + PRIOR_WEIGHT))
    lexicon.fuzzy = tuple(believed)
    lexicon.forms = {r["form"]: form_weight(r["t"], r["c"], lexicon.belief(r["entry"], r["edits"]), n_toxic, n_clean) for r in forms}
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon with weights from at most `rows` labelled documents."""
    train = training_documents(docs, labels, doc_id, text, label, rows)
    n_toxic, n_clean = class_counts(train)
    if not n_toxic or not n_clean:
        return lexicon_of([], 1, 1)
    lexicon = learned_forms(train, lexicon_of(telling_terms(train, n_toxic, n_clean), n_toxic, n_clean), n_toxic, n_clean)
    data = train.select(F.col("toxic").cast("double").alias("label"), measured(train, lexicon).alias("m"))
    data = VectorAssembler(inputCols=["strongest", "window"], outputCol="features").transform(staged(data.select("label", "m.strongest", "m.window"), "toxicity-features"))
    model = LogisticRegression(regParam=0.001, maxIter=50).fit(data)
    lexicon.coefficients = (*map(float, model.coefficients), float(model.intercept))
    return lexicon


def judge(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with a struct: hits (span, form, term, edits, quoted, weight), strongest, window and score (0 to 1)."""
    return docs.withColumn(out, measured(docs, lexicon, text))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The CRC-32 of an id's text modulo `folds`; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
