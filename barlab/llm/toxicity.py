"""Toxicity of whole texts by a weighted finite-state grammar over clauses.

Words fall into the classes insult, threat, target (second and third persons), negation, reporting and
strengthening; all others are fillers. Small transducers read a clause's classes from left to right: one each
for insults, threats and learnt words, and four for what stands around them. They are composed into one transducer
over tuples of their states, whose final states put out the classes of the matched clause: an insult, a threat or a
learnt word, plain or aimed at a target, negated or reported (before or behind), whether it is strengthened, and whether several learnt words stand in it. Each output has a weight;
a document's score is the sum over outputs of weight times log2(1 + clauses that put it out), and a base: all clauses of a text count,
with less for each further one. Words score nothing outside their clause.

The fixed words are mostly English. Words of the class `learnt` come from the labels, in whatever language
they are: of all words of all distinct labelled texts outside the held-out fold, counted by label, those that stand in
LEARN_TEXTS toxic texts or more and in hardly any clean one; copies count once, or one copied text would teach its words. Labels do not tell insults from threats, so learnt
words have a class of their own, which goes through the same transducers. No list is capped: the words are a table, which is
broadcast only where counted under LEARN_BROADCAST, and beyond it joined to the texts' words, so that a text gets its own hits alone.

The weights start from fixed values and are fit to the labels: the labelled rows outside the held-out fold are counted
by their clauses' classes over all rows, and a logistic model drawn towards the fixed weights is fit to the counts, whose
sums for each step Spark forms. For this each half of those rows is read with the words learnt from the other half, or a
word would vouch for the rows it was learnt from; that pass cannot be the one that scores, which has all words.

Cases: null and empty texts have no match and get the score of clean text; so do texts without letters.
Null or missing labels teach nothing; a document with several labels is toxic if one is. Repeated rows are each
scored; empty tables give empty results; other columns are kept by `drop_toxic`, ignored by `score`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from barlab.llm.common import checkpoint
from barlab.llm.langid import held_out

# The grammar's words.
INSULTS = (
    "idiot idiots moron morons stupid dumb scum trash loser losers clown clowns pathetic worthless disgusting imbecile cretin "
    "jerk bastard bastards bitch asshole douchebag retard retarded filthy vermin pig coward garbage freak creep "
    "imbécile crétin connard salaud ordure débile idiota imbécil estúpido estúpida basura inútil asqueroso "
    "dummkopf trottel abschaum arschloch idioten wertlos widerlich"
).split()
THREATS = "kill kills murder hurt destroy strangle stab shoot beat punch burn hang crush".split()
TARGETS = "you your you're u he she they them him her this that these those are is tu vous eres sois du ihr sie bist".split()
NEGATIONS = "not no never isn't aren't don't ain't nobody nor without pas jamais nunca nicht kein keine".split()
REPORTS = "said says called calls wrote writes quoted quote reported claims claimed accused told alleged".split()
STRONG = "so such total totally utter utterly complete completely absolute absolutely fucking damn bloody".split()

#: Outputs of the transducer.
CLASSES = (
    "insult", "insult_aimed", "insult_negated", "insult_reported", "threat", "threat_aimed", "threat_negated", "threat_reported",
    "learnt", "learnt_aimed", "learnt_negated", "learnt_reported", "learnt_more", "strengthened",
)
# Log-odds before any label is seen.
BASE_WEIGHT = -3.0
WEIGHTS = (3.5, 4.5, 1.0, 0.8, 1.2, 4.0, 0.3, 0.5, 1.5, 1.5, 0.3, 0.3, 1.5, 0.5)
#: Toxic texts that a learnt word stands in at least, and their least share of its texts.
LEARN_TEXTS, LEARN_SHARE = 3, 0.9
#: Learnt words that are broadcast at most.
LEARN_BROADCAST = 200_000
#: Strength of the pull towards the fixed weights, in labelled rows.
PRIOR_ROWS = 10.0
#: Score from which a document is taken for toxic.
THRESHOLD = 0.3

_CLASS_OF = {w: k for k, words in (("s", STRONG), ("g", TARGETS), ("r", REPORTS), ("n", NEGATIONS), ("t", THREATS), ("i", INSULTS)) for w in words}
_TRIGGER = r"(?i)\b(?:" + "|".join(re.escape(w) for w in sorted({*INSULTS, *THREATS}, key=len, reverse=True)) + r")\b"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"(?i)[.!?;\n]+|,\s+(?=(?:but|while|because|although|however|aber|weil|mais|pero)\b)")

# Transducers: (state, class) -> state; a class without an entry leaves the state.
_HITS = "itl"
_INSULT, _THREAT, _TARGET = {("0", "i"): "1"}, {("0", "t"): "1"}, {("0", "g"): "1"}
#: The second state: several learnt words.
_LEARNT = {("0", "l"): "1", ("1", "l"): "2"}
#: A negation reaches the insult, threat or learnt word after it; a second one lifts it.
_NEGATION = {("0", "n"): "near", ("near", "n"): "0", **{("near", c): "hit" for c in _HITS}}
#: Reported speech: a reporting word in front of the insult, threat or learnt word, or behind it.
_REPORTED = {("0", "r"): "near", ("behind", "r"): "hit", **{("near", c): "hit" for c in _HITS}, **{("0", c): "behind" for c in _HITS}}
#: A strengthening word in front of it.
_STRONG = {("0", "s"): "near", **{("near", c): "hit" for c in _HITS}}
MACHINES = (_INSULT, _THREAT, _LEARNT, _TARGET, _NEGATION, _REPORTED, _STRONG)


def outputs(states: tuple[str, ...]) -> tuple[str, ...]:
    """What a clause puts out that ends in these states of MACHINES."""
    *kinds, target, negation, reported, strong = states
    how = "_reported" if reported == "hit" else "_negated" if negation == "hit" else "_aimed" if target == "1" else ""
    out = [name + how for name, state in zip(("insult", "threat", "learnt"), kinds, strict=True) if state != "0"]
    out += ["learnt_more"] * (kinds[2] == "2" and how in ("", "_aimed"))
    return (*out, "strengthened") if out and strong == "hit" and how in ("", "_aimed") else tuple(out)


def compose(machines: tuple[dict, ...] = MACHINES, classes: str = "itlgnrs") -> tuple[list[dict[str, int]], list[tuple[int, ...]]]:
    """The machines as one: arcs and outputs (positions in CLASSES) of each state reached from the start, which is 0."""
    start = ("0",) * len(machines)
    number, arcs, queue = {start: 0}, [], [start]
    for states in queue:
        arcs.append({})
        for c in classes:
            after = tuple(m.get((s, c), s) for m, s in zip(machines, states, strict=True))
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
            arcs[-1][c] = number[after]
    return arcs, [tuple(CLASSES.index(name) for name in outputs(states)) for states in queue]


_ARCS, _OUTPUTS = compose()


def words_of(text: str) -> list[str]:
    lower = text.lower().replace("’", "'")
    return _WORD.findall(lower if lower.isascii() else unicodedata.normalize("NFC", lower))


def clause_outputs(words: list[str], learnt: frozenset[str] = frozenset()) -> tuple[int, ...]:
    """What the composed transducer puts out for the words of one clause."""
    state = 0
    for w in words:
        c = _CLASS_OF.get(w) or ("l" if w in learnt else None)
        if c:
            state = _ARCS[state][c]
    return _OUTPUTS[state]


def pattern_of(text: str, learnt: frozenset[str] = frozenset()) -> list[int]:
    """How many clauses of a text put out each of CLASSES."""
    counts = [0] * len(CLASSES)
    for clause in _CLAUSE_END.split(text):
        for k in clause_outputs(words_of(clause), learnt):
            counts[k] += 1
    return counts


@F.arrow_udf(ArrayType(StringType()))
def _distinct_words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's words, once each, but those that have a fixed class."""
    for column in texts:
        yield pa.array([sorted(set(words_of(t or "")) - _CLASS_OF.keys()) for t in column.to_pylist()], pa.list_(pa.string()))


_NOTHING = [0] * len(CLASSES)


def _patterns(learnt: Broadcast | None):
    """Patterns of texts: (text, by, hits). `by` tells each row's word list, and `hits` has a text's learnt words where these are not broadcast.

    Texts without a fixed trigger or a learnt word are left out by cheap passes.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def pattern(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lists = learnt.value if learnt else None
        for texts, by, hits in columns:
            fixed = pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), _TRIGGER), False).to_pylist()
            out = []
            for text, k, hit, own in zip(texts.to_pylist(), by.to_pylist(), fixed, hits.to_pylist(), strict=True):
                words = lists[k] if lists else frozenset(x["word"] for x in own or () if x["told"][k])
                found = text and (hit or (words and not words.isdisjoint(words_of(text))))
                out.append(pattern_of(text, words) if found else _NOTHING)
            yield pa.array(out, pa.list_(pa.int32()))

    return pattern


def features(counts: np.ndarray) -> np.ndarray:
    """What the weights are for: a first clause counts 1, each further one less."""
    return np.log2(1 + counts)


def _moments(w: np.ndarray):
    """Gradient and curvature of the likelihood at the weights `w`, over the rows that a task has: one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w) + 1, len(w)))
        for batch in batches:
            rows, toxic = (c.to_numpy() for c in batch.columns[1:])
            x = np.column_stack([np.ones(len(rows)), features(batch.column(0).flatten().to_numpy().reshape(len(rows), -1))])
            p = 1 / (1 + np.exp(-x @ w))
            total[0] += x.T @ (toxic - rows * p)
            total[1:] += (x * (rows * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    return run


def fit(counts: DataFrame) -> np.ndarray:
    """Weights (base first) from (pattern, rows, toxic rows): a logistic model near the fixed weights."""
    start = np.array([BASE_WEIGHT, *WEIGHTS])
    w, pull = start.copy(), np.full(len(start), PRIOR_ROWS / 10)
    for _ in range(50):
        sums = sum((np.array(r["m"]) for r in counts.mapInArrow(_moments(w), "m array<double>").collect()), np.zeros(len(w) * (len(w) + 1)))
        slope, curve = np.split(sums.reshape(-1, len(w)), [1])
        step = np.clip(np.linalg.solve(curve + np.diag(pull), slope[0] - pull * (w - start)), -2, 2)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))


def learn_words(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows: (doc_id, text, half) to learn from; a text has one half. (word, told): whether all of them, half 0 and half 1 tell it."""
    text = F.xxhash64("text").alias("h")
    one = rows.select("doc_id", text).join(_known(labels).hint("merge"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    seen = rows.select("*", text).join(one.hint("merge"), ["doc_id", "h"]).select("half", "toxic", F.explode(_distinct_words("text")).alias("word"))
    first, toxic = (F.col("half") == 0).cast("long"), F.col("toxic")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"), F.sum(first).alias("n0"), F.sum(first * toxic).alias("k0"))
    counts = counts.withColumns({"n1": F.col("n") - F.col("n0"), "k1": F.col("k") - F.col("k0")})
    told = [(F.col(k) >= LEARN_TEXTS) & (F.col(k) >= LEARN_SHARE * F.col(n)) for k, n in (("k", "n"), ("k0", "n0"), ("k1", "n1"))]
    return checkpoint(counts.where(told[0] | told[1] | told[2]).select("word", F.array(*told).alias("told")))


class _Learnt:
    """Learnt words in the form that their number asks for: broadcast, or a table that is joined to the texts' words."""

    def __init__(self, words: DataFrame):
        self.words, self.shared = words, None
        if words.count() <= LEARN_BROADCAST:
            found = words.collect()
            self.shared = words.sparkSession.sparkContext.broadcast([frozenset(r["word"] for r in found if r["told"][i]) for i in range(3)])

    def patterns(self, rows: DataFrame, text: str, by: Column) -> tuple[DataFrame, Column]:
        """`rows`, with hits where they come from a join, and the column of their patterns."""
        none = F.lit(None).cast("array<struct<word:string,told:array<boolean>>>")
        if self.shared:
            return rows, _patterns(self.shared)(text, by, none)
        # hits hang on the text alone, so they are found once for each
        told = [F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(1), text).alias("__g")]
        words = rows.select(*told, F.explode(_distinct_words(text)).alias("word")).distinct()
        hits = words.join(self.words.hint("merge"), "word").groupBy("__h", "__g").agg(F.collect_list(F.struct("word", "told")).alias("__hits"))
        met = rows.select("*", *told).join(checkpoint(hits).hint("merge"), ["__h", "__g"], "left").drop("__h", "__g")
        return met, _patterns(None)(text, by, F.col("__hits"))


def _learn(patterns: DataFrame, labels: DataFrame) -> np.ndarray:
    """patterns: (doc_id, pattern) to learn from. Counted by pattern over all labelled rows of them."""
    learn = patterns.join(_known(labels).hint("merge"), "doc_id")
    return fit(checkpoint(learn.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> tuple[_Learnt, np.ndarray]:
    """The learnt words (by all, half 0, half 1) and the weights, both learnt outside the fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~held_out(F.col("doc_id"), folds, fold))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    learnt = _Learnt(learn_words(rows, labels))
    # patterns before the join to the labels, so that it moves short rows
    met, pattern = learnt.patterns(rows, "text", 2 - F.col("half"))
    return learnt, _learn(met.select("doc_id", pattern.alias("pattern")), labels)


def score_of(pattern: Column, weights: np.ndarray) -> Column:
    total = F.lit(float(weights[0]))
    for k, w in enumerate(weights[1:]):
        total = total + F.log2(F.lit(1.0) + pattern[k]) * F.lit(float(w))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, pattern of every row."""
    learnt, weights = _fitted(docs, labels, id_col, text_col, folds, fold)
    met, pattern = learnt.patterns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", F.lit(0))
    found = met.select("doc_id", pattern.alias("pattern"))
    value = score_of(F.col("pattern"), weights)
    out = found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), value.alias("score"), "pattern")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "pattern")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score `threshold` or more."""
    learnt, weights = _fitted(docs, labels, id_col, text_col, folds, fold)
    met, pattern = learnt.patterns(docs, text_col, F.lit(0))
    return met.withColumn("__pattern", pattern).where(score_of(F.col("__pattern"), weights) < threshold).select(*docs.columns)
