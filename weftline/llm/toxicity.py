"""Toxicity by a weighted finite-state grammar over clauses.

Words map to symbols: insult, threat, target, negator, reporting verb, intensifier, learned, other.  A clause's symbols pass
through a cascade of small transducers, each reading what the one before it writes: the first marks what stands in the
scope of a negator, the second what follows a reporting verb, the third what follows a target.  A second cascade reads the
result from the right and adds reporting verbs and targets that come later, and its last member writes the production that
matched: insult, threat or learned word, aimed or bare, negated or not, reported or not.  Both cascades are composed into one
table each (a bimachine), so a clause is read twice whatever the grammar.  Every production has a weight, learned from
labelled rows; the score is the logistic of the weighted productions of all clauses, not of words.  That a bare word
counts at all is for the labels to say: its production has a weight of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import LOWER, U64, Chunk, small_batches, span_hashes, steady, stream, text_chunks

# The grammar's words (lower case; English, French, German, Spanish).
LEXICON = {
    "insult": """idiot idiots moron morons scum trash worthless stupid loser losers clown clowns disgusting pathetic dumb fool fools
        imbecile imbeciles dimwit filth filthy vermin coward creep jerk scumbag garbage lowlife parasite degenerate brainless
        ugly bastard bitch asshole crétin abruti débile connard salope ordure trottel dummkopf arschloch abschaum widerlich
        estúpido estúpida imbécil basura asqueroso asquerosa inútil escoria payaso""",
    "threat": """kill murder shoot stab strangle slaughter beat crush hurt destroy burn hang bomb tuer frapper brûler égorger töten
        umbringen erschlagen verbrennen matar golpear quemar degollar""",
    "target": """you your yours yourself he him his she her they them their these those people everyone everybody
        tu toi vous votre ils elles eux du dich dein ihr euch tú usted ustedes ellos ellas""",
    "negator": """not no never neither nor none without isn't aren't don't doesn't didn't wasn't weren't can't won't cannot
        pas jamais aucun sans nicht kein keine keinen niemals ohne nunca jamás ningún sin""",
    "report": """said says say quoted quotes quote claimed claims wrote writes reported reports told tells alleged
        dit disait écrit affirme sagte sagt schrieb behauptet dijo dice escribió afirma""",
    "intensifier": "so such very really total totally complete completely utter utterly fucking damn absolute absolutely",
}
SYMBOLS = ["other", *LEXICON, "learned"]
_CODE = {name: i for i, name in enumerate(SYMBOLS)}
INSULT, THREAT, TARGET, NEGATOR, REPORT, INTENSIFIER, LEARNED = (_CODE[s] for s in SYMBOLS[1:])
#: words that a negator reaches, and words a target may stand away
REACH, NEAR = 3, 4
KINDS = [f"{what}_{aim}_{neg}_{rep}" for what, aim, neg, rep in product(("insult", "threat", "learned"), ("bare", "aimed"), ("plain", "negated"), ("direct", "reported"))]

# A transducer is (states, step): step(state, symbol) gives the next state and the symbol written.  Symbols grow by a mark
# from member to member: (word,), (word, negated), (word, negated, reported), (word, negated, reported, aimed).
_NEGATION = (REACH + 1, lambda s, x: (REACH if x[0] == NEGATOR else s if x[0] == INTENSIFIER else max(0, s - 1), (*x, s > 0)))
_REPORTED = (2, lambda s, x: (1 if x[0] == REPORT else s, (*x, s > 0)))
_AIMED = (NEAR + 1, lambda s, x: (NEAR if x[0] == TARGET else max(0, s - 1), (*x, s > 0)))
_REPORTED_LATER = (2, lambda s, x: (1 if x[0] == REPORT else s, (x[0], x[1], x[2] or s > 0, x[3])))
_AIMED_LATER = (NEAR + 1, lambda s, x: (NEAR if x[0] == TARGET else max(0, s - 1), (*x[:3], x[3] or s > 0)))
_WHAT = {INSULT: 0, THREAT: 1, LEARNED: 2}
_PRODUCTION = (1, lambda s, x: (0, _WHAT[x[0]] * 8 + x[3] * 4 + x[1] * 2 + x[2] if x[0] in _WHAT else None))


def compose(first, second):
    """One transducer that does what ``second`` does with what ``first`` writes; its states are pairs."""
    (n, f), (m, g) = first, second

    def step(state, x):
        a, y = f(state // m, x)
        b, z = g(state % m, y)
        return a * m + b, z

    return n * m, step


def table(transducer, symbols: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Next states and written symbols by (state, number of the symbol read), and the written symbols by number."""
    n, step = transducer
    written: dict = {}
    to, out = np.zeros((n, len(symbols)), np.int64), np.zeros((n, len(symbols)), np.int64)
    for s in range(n):
        for i, x in enumerate(symbols):
            to[s, i], y = step(s, x)
            out[s, i] = written.setdefault(y, len(written))
    return to, out, list(written)


_TO, _OUT, _MARKED = table(compose(compose(_NEGATION, _REPORTED), _AIMED), [(x,) for x in range(len(SYMBOLS))])
_BACK_TO, _BACK_OUT, _WRITTEN = table(compose(compose(_REPORTED_LATER, _AIMED_LATER), _PRODUCTION), _MARKED)
_TO, _OUT, _BACK_TO, _BACK_OUT = (t.tolist() for t in (_TO, _OUT, _BACK_TO, _BACK_OUT))

_BYTE = stream(505, 256)
_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256), 0x27]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?;:\n"]] = True


class Lexicon:
    """Hashes of the known words, sorted, and their symbols; learned words are added to the fixed ones."""

    def __init__(self, learned: np.ndarray | None = None):
        words = {w.encode(): _CODE[kind] for kind, text in LEXICON.items() for w in text.split()}
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        keys = span_hashes(_BYTE[data], ends - [len(w) for w in words], ends)
        symbols = np.array(list(words.values()))
        if learned is not None:
            learned = np.setdiff1d(learned, keys)
            keys, symbols = np.concatenate([keys, learned]), np.concatenate([symbols, np.full(len(learned), LEARNED)])
        order = np.argsort(keys)
        self.keys, self.symbols = keys[order], symbols[order].astype(np.int8)
        self.probe = np.zeros(1 << 16, bool)
        self.probe[(self.keys >> U64(48)).astype(np.int64)] = True

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The symbol of each word hash."""
        out = np.zeros(len(keys), np.int8)
        maybe = np.flatnonzero(self.probe[(keys >> U64(48)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        ok = self.keys[where] == keys[maybe]
        out[maybe[ok]] = self.symbols[where[ok]]
        return out


def letter_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words (runs of letters and apostrophes within a document) and their lower-case hashes."""
    n = len(chunk.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[chunk.data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, span_hashes(_BYTE[LOWER[chunk.data]], starts, ends) if len(starts) else np.zeros(0, U64)


def clause_matches(symbols: list[int]) -> list[int]:
    """Numbers of the productions (of ``KINDS``) that match in one clause, in order: both passes of the bimachine."""
    marked, state = [], 0
    for x in symbols:
        marked.append(_OUT[state][x])
        state = _TO[state][x]
    found, state = [], 0
    for y in reversed(marked):
        kind = _WRITTEN[_BACK_OUT[state][y]]
        state = _BACK_TO[state][y]
        if kind is not None:
            found.append(kind)
    return found[::-1]


def match_counts(chunk: Chunk, lexicon: Lexicon) -> np.ndarray:
    """Counts of each kind of match in each document of the chunk."""
    out = np.zeros((len(chunk), len(KINDS)), np.int32)
    n = len(chunk.data)
    starts, keys = letter_words(chunk)
    if not len(starts):
        return out
    symbols = lexicon.of(keys)
    hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT) | (symbols == LEARNED))
    if not len(hits):
        return out
    stops = np.zeros(n + 1, np.int64)
    np.cumsum(_STOP[chunk.data], out=stops[1:])
    doc = np.searchsorted(chunk.bounds, starts, "right") - 1
    clause = stops[starts] + doc * np.int64(n + 1)  # grows from clause to clause and from document to document
    first, last = np.searchsorted(clause, clause[hits]), np.searchsorted(clause, clause[hits], "right")
    for a, b in dict.fromkeys(zip(first.tolist(), last.tolist(), strict=True)):
        for kind in clause_matches(symbols[a:b].tolist()):
            out[doc[a], kind] += 1
    return out


def match_table(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, matches): counts of the kinds of ``KINDS`` over the whole text, one row for each of ``docs``.

    Null and empty texts have none.  Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # the fixed words and those learned from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(match_counts(chunk, shared.value).tolist(), pa.list_(pa.int32()))], ["doc_id", "matches"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, matches array<int>")


#: labelled rows that words and weights are learned from
SAMPLE = 30_000
#: what a learned word must show: toxic documents in distinct contexts, their share, log-likelihood above chance
MIN_CONTEXTS, MIN_SHARE, MIN_EVIDENCE = 4, 0.5, 12.0
#: weights where there is nothing to learn from: bias, then one for each kind
PRIOR = np.array([-4.0, *(4.0 + 2.0 * ("aimed" in k) + 1.0 * ("threat" in k) - 4.0 * ("negated" in k) - 3.0 * ("reported" in k) for k in KINDS)])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to a row for each distinct word of a document: its hash, the label, the words around it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for chunk in text_chunks(batch.column(0)):
            starts, keys = letter_words(chunk)
            doc = np.searchsorted(chunk.bounds, starts, "right") - 1
            around = np.zeros(len(keys), U64)
            around[1:] += keys[:-1]
            around[:-1] += keys[1:] * U64(3)
            order = np.lexsort((keys, doc))
            first = np.ones(len(order), bool)
            first[1:] = (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            at = order[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array(toxic[chunk.first + doc[at]] > 0), pa.array(around[at].view(np.int64))], ["word", "toxic", "around"])


def learned_words(train: DataFrame) -> np.ndarray:
    """Hashes of all words that mark toxic rows of ``train`` (text, toxic), which is a bounded sample."""
    sizes = {bool(r[0]): r[1] for r in train.groupBy(F.col("toxic") > 0).count().collect()}
    if len(sizes) < 2:
        return np.zeros(0, U64)
    base = sizes[True] / (sizes[True] + sizes[False])
    words = train.select("text", F.col("toxic").cast("int")).mapInArrow(_word_rows, "word long, toxic boolean, around long")
    found = words.groupBy("word").agg(
        F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("q"), F.approx_count_distinct(F.when(F.col("toxic"), F.col("around"))).alias("contexts"))
    n = F.col("p") + F.col("q")
    evidence = F.col("p") * F.log(F.col("p") / (n * base)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / (n * (1 - base)))).otherwise(0.0)
    found = found.where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("p") >= MIN_SHARE * n)).withColumn("e", evidence).where(F.col("e") >= MIN_EVIDENCE)
    rows = found.select("word").collect()
    return np.array([r[0] for r in rows], np.int64).view(U64)


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> np.ndarray:
    """Logistic weights over ln(1 + count), pulled towards the prior; ``n`` counts equal rows.  Newton steps."""
    z = np.concatenate([np.ones((len(x), 1)), np.log1p(x)], axis=1)
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (n * (y - p)) - ridge * (w - PRIOR)
        hessian = (z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(train: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Weights from the rows of ``train`` (doc_id, text, toxic)."""
    counted = match_table(train.select(F.col("toxic").cast("long").alias("doc_id"), "text"), lexicon)
    rows = counted.groupBy("matches", F.col("doc_id") > 0).count().collect()  # few distinct count vectors
    if not rows:
        return PRIOR
    return fit_weights(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))


def score(matches: DataFrame, weights: np.ndarray) -> DataFrame:
    """``matches`` with the score of each document: the logistic of its weighted counts."""
    sums = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:].tolist()):
        sums = sums + F.log1p(F.col("matches")[i].cast("double")) * w
    return matches.withColumn("score", 1 / (1 + F.exp(-sums)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` labelled rows (text, toxic), drawn by a hash of doc_id before the join."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id").cast("long")), F.lit(1 << 20)) < min(1.0, sample / max(1, known.count())) * (1 << 20)
    some = docs.where(drawn).select("doc_id", F.col("text").cast("string").alias("text"))
    return steady(some.join(known.where(drawn), "doc_id").select("text", "toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, trained_on: Column | None = None) -> DataFrame:
    """Rows (doc_id, score, matches), one for each row of ``docs``.

    Words and weights are learned from ``labels`` of documents that the condition ``trained_on`` allows (all by
    default); without labelled rows a fixed prior scores.  Null, empty and wordless texts get the score of no match.
    Null labels are left out; a null doc_id is scored, never learned from.
    """
    small_batches(docs.sparkSession)
    train = training_rows(docs if trained_on is None else docs.where(trained_on), labels)
    lexicon = Lexicon(learned_words(train))
    return score(match_table(docs, lexicon), learn(train, lexicon))
