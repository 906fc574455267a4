"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns the words of a clause into classes: insult, threat,
target, negation, reported speech, other, with a weight for insults and threats.
Five small transducers read the classes and mark what they find: an insult, a
threat, a target near one (before it or right behind it), a negation whose scope
it stands in, reported speech in front of it. They are composed once into a single
machine, whose marks at the end of a clause are the clause's pattern, one of 16. A
clause with an insult or threat matches with the sum of its word weights; words
alone score nothing. A document's score is a logistic function of the strengths of
its matched clauses by pattern, with one learned weight for each pattern, held
near the grammar's own weight where labelled rows say little of it.

Insults are learned from labelled rows: whole words and word stems (the first
bytes) that stand in toxic documents more often than chance allows for the number
of terms tried, with log-odds as weights. Copies of one text would make its rare
words look like insults, so a term's support is the number of its different left
neighbours, by a 64-bit linear-counting sketch, where that is less than the number
of documents. Pattern weights are fitted on clauses matched by the lexicon of the
other half of the labelled rows, so no row is judged by words learned from it. The
sample of labelled rows is bounded (`SAMPLE` rows in order of a hash of their id);
every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, arrow_rows, mix, slices, span_hashes, stage

SAMPLE, THRESHOLD = 20_000, 0.3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Everyday function words and insults of four languages.
WORDS = {
    TARGET: "you your you're u ur he she they him her them du dich dir ihr euch sie tu toi vous ton votre ils elle usted ustedes vosotros tú ellos",
    NEGATION: "not never isn't aren't wasn't without nicht kein keine nie jamais aucun nunca jamás ningún",
    REPORT: "said says wrote quoted reported called sagte sagt schrieb dit écrit dijo dice escribió",
    THREAT: "kill hurt murder destroy stab strangle töten umbringen tuer frapper matar golpear",
    INSULT: "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb jerk imbecile trottel abschaum versager crétin imbécile connard minable idiota imbécil estúpido escoria payaso",
}
SEED_WEIGHT, THREAT_WEIGHT, STEMS = 4.0, 4.0, range(3, 10)

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = IS_WORD[39] = True
ENDS_CLAUSE = np.zeros(256, dtype=bool)
ENDS_CLAUSE[[ord(c) for c in ".!?;:\n()\""]] = True


#: Marks of the transducers. A clause's pattern is its kind and the marks at its strongest place.
IS_INSULT, IS_THREAT, TARGETED, NEGATED, REPORTED = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, class) -> (state, marks); start state 0, missing arcs stay without marks."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, 0))

    def compose(self, other: Transducer) -> Transducer:
        """The machine that runs both on the same classes and joins their marks, with only the states that it can reach."""
        number, queue, arcs = {(0, 0): 0}, [(0, 0)], {}
        for pair in queue:
            for symbol in range(6):
                (a, x), (b, y) = self.step(pair[0], symbol), other.step(pair[1], symbol)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    queue.append((a, b))
                arcs[number[pair], symbol] = number[a, b], x | y
        return Transducer(arcs)


def marks(symbol: int, mark: int) -> Transducer:
    """Marks one class wherever it stands."""
    return Transducer({(0, symbol): (0, mark)})


def before(trigger: int, reach: int, mark: int, symbols: tuple[int, ...] = (INSULT, THREAT)) -> Transducer:
    """Marks classes that a trigger stands at most `reach` words before; state k has k words of reach left."""
    return Transducer({(k, c): (reach if c == trigger else max(k - 1, 0), mark if k and c in symbols else 0) for k in range(reach + 1) for c in range(6)})


def target() -> Transducer:
    """Marks an insult or threat with a target up to five words before it, and a target up to two words behind one."""
    ahead, behind = before(TARGET, 5, TARGETED), {}
    for k in range(3):
        for c in range(6):
            behind[k, c] = (2 if c in (INSULT, THREAT) else max(k - 1, 0)), TARGETED if k and c == TARGET else 0
    return ahead.compose(Transducer(behind))


def grammar() -> Transducer:
    report = Transducer({(s, c): (1 if s or c == REPORT else 0, REPORTED if s and c in (INSULT, THREAT) else 0) for s in (0, 1) for c in range(6)})
    return marks(INSULT, IS_INSULT).compose(marks(THREAT, IS_THREAT)).compose(target()).compose(before(NEGATION, 3, NEGATED)).compose(report)


#: Patterns by number: threat or insult, and three marks. Weights before any label is seen.
PATTERNS = [(threat, t, n, r) for threat in (0, 1) for t in (0, 1) for n in (0, 1) for r in (0, 1)]
PRIOR = np.array([(1.0 if not threat else 0.15 if not t else 1.0) * (1.4 if t else 1.0) * (0.4 if n else 1.0) * (0.6 if r else 1.0) for threat, t, n, r in PATTERNS])


def match(machine: Transducer, classes: list[int], weights: list[float]) -> tuple[int, float]:
    """(pattern, strength) of a clause: all marks of the path, the kind of its heaviest word, the sum of its words' weights."""
    state = seen = 0
    for c in classes:
        state, found = machine.step(state, c)
        seen |= found
    threat = seen & IS_THREAT and (seen & TARGETED or not seen & IS_INSULT)
    pattern = 8 * bool(threat) + 4 * bool(seen & TARGETED) + 2 * bool(seen & NEGATED) + bool(seen & REPORTED)
    return pattern, sum(weights)


def _tokens(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, rows and clauses of the words of a slice (letters, apostrophes, any byte above 127), and its bytes in lower case."""
    low = LOWER[flat]
    accent = np.zeros(len(low), dtype=bool)  # Latin capitals of two bytes
    accent[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
    low = np.where(accent, low + np.uint8(0x20), low)
    solid = IS_WORD[flat]
    cut = np.zeros(len(flat) + 1, dtype=bool)
    cut[at] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    clause = np.cumsum(ENDS_CLAUSE[flat] | cut[:-1])[starts]
    return starts, stops - starts, row, clause, low


def _term(low: np.ndarray, starts: np.ndarray, n: np.ndarray, whole: bool) -> np.ndarray:
    return mix(span_hashes(low, starts, starts + n) + np.uint64(whole))


def word_term(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    starts, n, _, _, low = _tokens(data, np.array([0, len(data)]))
    return int(_term(low, starts[:1], n[:1], True)[0])


def _terms(starts: np.ndarray, n: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words' places, hashes) for whole words and for each stem length."""
    yield np.arange(len(starts)), _term(low, starts, n, True)
    for k in STEMS:
        at = np.flatnonzero(n > k)
        yield at, _term(low, starts[at], np.full(len(at), k), False)


def term_statistics(texts: DataFrame) -> DataFrame:
    """term, fold, docs1, docs0, neighbours: documents of either label that have a term, and a sketch of its left neighbours in toxic ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for i, flat, at in slices(batch.column(0)):
                starts, n, row, _, low = _tokens(flat, at)
                if not len(starts):
                    continue
                before_it = np.concatenate([[np.uint64(0)], _term(low, starts, n, True)[:-1]]) >> np.uint64(58)
                places, terms = zip(*_terms(starts, n, low), strict=True)
                place, term = np.concatenate(places), np.concatenate(terms)
                toxic, half = label[i + row[place]].astype(bool), fold[i + row[place]]
                order = np.lexsort((row[place], term, half))
                t, r, y, f = term[order], row[place][order], toxic[order], half[order]
                head = np.ones(len(t), dtype=bool)
                head[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
                first = head.copy()
                first[1:] |= r[1:] != r[:-1]
                new = np.flatnonzero(head)
                bits = np.where(y, np.uint64(1) << before_it[place[order]], np.uint64(0))
                cols = [t[new].view(np.int64), f[new], np.add.reduceat((first & y).astype(np.int64), new), np.add.reduceat((first & ~y).astype(np.int64), new), np.bitwise_or.reduceat(bits, new).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["term", "fold", "docs1", "docs0", "neighbours"])

    found = texts.select("text", "label", "fold").mapInArrow(work, "term long, fold int, docs1 long, docs0 long, neighbours long")
    return found.groupBy("term", "fold").agg(F.sum("docs1").alias("docs1"), F.sum("docs0").alias("docs0"), F.bit_or("neighbours").alias("neighbours"))


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    classes: np.ndarray
    offset: float = -2.0
    patterns: np.ndarray = field(default_factory=PRIOR.copy)


def _lexicon(learned: dict[int, float]) -> Model:
    """The fixed words and the learned insults."""
    lexicon = {word_term(w): (c, {INSULT: SEED_WEIGHT, THREAT: THREAT_WEIGHT}.get(c, 0.0)) for c, words in WORDS.items() for w in words.split()}
    lexicon |= {t: (INSULT, w) for t, w in learned.items()}
    terms = np.array(sorted(lexicon), dtype=np.uint64)
    return Model(terms, np.array([lexicon[int(t)][1] for t in terms]), np.array([lexicon[int(t)][0] for t in terms]))


def learn_lexicons(texts: DataFrame) -> list[Model]:
    """Lexicons from all rows of (text, label, fold), from fold 0 alone and from fold 1 alone."""
    totals = {(r["label"], r["fold"]): r["n"] for r in texts.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    each = term_statistics(texts).select("term", F.when(F.col("fold") == 0, F.struct("docs1", "docs0", "neighbours")).alias("f0"), F.when(F.col("fold") == 1, F.struct("docs1", "docs0", "neighbours")).alias("f1"))
    both = each.groupBy("term").agg(F.max("f0").alias("f0"), F.max("f1").alias("f1"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.struct((n("f0.docs1") + n("f1.docs1")).alias("docs1"), (n("f0.docs0") + n("f1.docs0")).alias("docs0"), n("f0.neighbours").bitwiseOR(n("f1.neighbours")).alias("neighbours"))
    halves = {"all": (0, 1), "f0": (0,), "f1": (1,)}
    columns, floor = [], 10.0
    counted = both.withColumn("all", whole)
    for name, folds in halves.items():
        n1, n0 = (sum(totals.get((v, f), 0) for f in folds) for v in (1, 0))
        if not n1 or not n0:
            columns.append(F.lit(None).cast("struct<gain: double, weight: double>").alias(name))
            continue
        p = n1 / (n1 + n0)
        empty = F.lit(64.0) - F.bit_count(f"{name}.neighbours")
        spread = F.when(empty > 0, -64.0 * F.log(empty / 64.0)).otherwise(1e9)
        m1, m0 = F.least(F.col(f"{name}.docs1").cast("double"), spread), F.col(f"{name}.docs0")
        share = (m1 + 0.5) / (m1 + m0 + 1.0)
        gain = m1 * F.log(share / p) + m0 * F.log((1 - share) / (1 - p))
        weight = F.least(F.log(share / (1 - share)) - F.lit(float(np.log(p / (1 - p)))), F.lit(8.0))
        columns.append(F.when((share > max(0.5, 2 * p)) & (gain > floor), F.struct(gain.alias("gain"), weight.alias("weight"))).alias(name))
    found = counted.select("term", *columns).withColumn("term", F.when(F.coalesce("all", "f0", "f1").isNotNull(), F.col("term")))
    # the terms that come to nothing are one row, which says how many were tried
    rows = found.groupBy("term").agg(*(F.max(name).alias(name) for name in halves), F.count("*").alias("n")).collect()
    # a term by chance has a gain of at most about the log of the number of terms tried
    bar = max(floor, float(np.log(max(sum(r["n"] for r in rows), 1))) + 0.6)
    return [_lexicon({r["term"] & (1 << 64) - 1: r[name]["weight"] for r in rows if r["term"] is not None and r[name] and r[name]["gain"] > bar}) for name in halves]


def evidence(docs: DataFrame, models: list[Model]) -> DataFrame:
    """All columns but `text`, and for each model the strengths of the matched clauses by pattern (m0, m1, ...: arrays of 16)."""
    rest = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast((models, grammar()))  # the terms that a bounded sample of rows teaches
    names = [*rest, *(f"m{k}" for k in range(len(models)))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, machine = shared.value
        gates = []
        for lexicon in lexicons:
            gates.append(np.zeros(1 << 16, dtype=bool))
            gates[-1][lexicon.terms >> np.uint64(48)] = True
        for batch in batches:
            found = np.zeros((len(lexicons), len(batch), len(PATTERNS)))
            for i, flat, at in slices(batch.columns[-1]):
                starts, n, row, clause, low = _tokens(flat, at)
                terms = list(_terms(starts, n, low))
                for lexicon, gate, out in zip(lexicons, gates, found, strict=True):
                    kind, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
                    for place, term in terms:
                        maybe = np.flatnonzero(gate[term >> np.uint64(48)])
                        k = np.searchsorted(lexicon.terms, term[maybe])
                        hit = lexicon.terms[np.minimum(k, len(lexicon.terms) - 1)] == term[maybe]
                        k, where = k[hit], place[maybe[hit]]
                        better = (lexicon.weights[k] > weight[where]) | (kind[where] == OTHER)
                        kind[where[better]], weight[where[better]] = lexicon.classes[k[better]], lexicon.weights[k[better]]
                    live = np.unique(clause[(kind == INSULT) | (kind == THREAT)])
                    for lo, hi in zip(np.searchsorted(clause, live), np.searchsorted(clause, live, side="right"), strict=True):
                        pattern, strength = match(machine, kind[lo:hi].tolist(), weight[lo:hi].tolist())
                        out[i + row[lo], pattern] += strength
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(PATTERNS)).cast(pa.list_(pa.float64())) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=names)

    plain = docs.select(*rest, "text")
    kinds = [*(f"`{c}` {k}" for c, k in plain.select(*rest).dtypes), *(f"m{k} array<double>" for k in range(len(models)))]
    return plain.mapInArrow(work, ", ".join(kinds))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Offset and a weight for each pattern of a logistic curve, pulled towards -2 and the grammar's own weights; no weight is below 0."""
    prior = np.concatenate([[-2.0], PRIOR])
    pull = np.concatenate([[0.5], np.full(len(PRIOR), 4.0)])
    x = np.column_stack([np.ones(len(x)), x])
    a = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (y - p) - pull * (a - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        a = a + np.clip(step, -0.5, 0.5)
        a[1:] = np.maximum(a[1:], 0.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), a[1:]


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out; without any, the fixed words and the grammar's own weights stand alone."""
    arrow_rows(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    # copies of a text are in the same half
    texts = stage(texts.select("doc_id", "text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")), "labelled")
    model, *halves = learn_lexicons(texts)
    other = F.when(F.col("fold") == 0, F.col("m1")).otherwise(F.col("m0")).alias("x")
    judged = evidence(texts.select("doc_id", "label", "fold", "text"), halves).select("doc_id", "label", other)
    pairs = judged.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("x").alias("x")).select("x", "label").toArrow()  # `sample` rows at most
    if len(pairs):
        x = pairs.column("x").combine_chunks().flatten().to_numpy().reshape(len(pairs), -1)
        model.offset, model.patterns = calibrate(x, pairs.column("label").to_numpy().astype(float))
    return model


def _evidence(model: Model):
    return sum((F.lit(float(w)) * F.get("m0", F.lit(k)) for k, w in enumerate(model.patterns)), F.lit(0.0))


def _score(model: Model):
    return 1 / (1 + F.exp(-(F.lit(model.offset) + _evidence(model))))


def rejected(docs: DataFrame, model: Model, keep: bool = False, text_col: str = "text") -> DataFrame:
    """The rows, all their columns, whose score is 0.3 or more, or with `keep` the others. No join: texts pass through."""
    arrow_rows(docs.sparkSession)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    found = evidence(docs.select(*columns, F.col(f"`{text_col}`").alias("text")), [model])
    bad = _score(model) >= THRESHOLD
    return found.where(~bad if keep else bad).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence and patterns (strengths of matched clauses) for every row.

    The score is a chance from 0 to 1; predicted is 1 from 0.3 on. Only the text is
    looked at: a null, empty or wordless text has the score of no evidence. Labels
    whose id's crc32 leaves 2 on division by 4 are never read; null labels and ids
    are skipped, and of several labels of one id the highest counts. Rows with null
    ids are scored and not held out; repeated rows stay; an empty table gives none.
    Columns other than the id and the text are ignored.
    """
    model = fit(docs, labels, id_col, text_col)
    found = evidence(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), [model])
    score = _score(model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), _evidence(model).alias("evidence"), F.col("m0").alias("patterns"))
