"""Quality classifier from weak labels.

Two questions are asked of a document: is it of low quality, is it toxic. Several overlapping labellers
vote on each (1 yes, -1 no, 0 no opinion): heuristics, each over a measure or a word list of its own, which say
yes and no, and, where a table of annotations is given, the annotators as one more labeller.
Expectation-maximisation over the counts of vote patterns estimates how common yes is, and for each
labeller, the annotators too, how often it says yes where the answer is yes and no where it is no; and with
these the posterior of every pattern. The annotators' two shares have a prior of ``ANNOTATOR``, which weighs
as much as the votes that they cast: it says which of two labellers that contradict each other is to be
believed at first. Without annotations the heuristics are compared with each other alone.

The posteriors, with yes and no as likely beforehand, are the labels of a logistic scorer, each with the weight of what
its votes say (``evidence``: that a word of a list is missing says little), over hashed features (distinct
words, their first 4 and 5 letters, and families: first 5 letters that several words of the text share) and a few exact ones
(levels of the text's measures, signs of insult). Hashed features of fewer than ``min_docs`` documents of the sample have no
weight, as they would learn those documents by heart. It is fitted by L-BFGS, whose gradients Spark sums over a sample of about ``train_rows``
documents chosen by the hash of the id and the text, in which equal documents are one row that counts
as many times: an id, or a text, that fills much of the table does not swell it. A gradient comes to
the driver as one number for each feature and question. The scorer then judges every document, over its whole text.

Edge cases: null texts and texts without words are of low quality (p_low 1, p_toxic 0); repeated
rows are scored alike; contradicting annotations of one id count as no opinion, and so do null ones;
a document of null id has no annotation; without any vote on a question its score is 0 everywhere; an
empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow, slices
from evidentia.llm.tables import discard, stored, tidy

SLOTS = 1 << 16
#: Slots of families, after SLOTS; at least ``FAMILY`` of a text's distinct words, and one in a hundred, make one.
FAMILIES, FAMILY = 1 << 14, 3
HASHED = SLOTS + FAMILIES
LEVELS = 20
#: Signs of insult that are features of their own, after HASHED and the levels of five measures.
SIGNS = 4
SIZE = HASHED + 5 * LEVELS + SIGNS
#: Values of the hashed words and letters, and of all features from SLOTS on: the penalty bears least on these, of which a text has few,
#: so that what many documents share is learnt before the words of each.
WEAK, STRONG = 0.5, 4.0
WORD = re.compile(r"\w+")
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
#: Words that belittle someone's mind, that deny someone's worth, that say someone disgusts, and beginnings of words derived from any.
MIND = frozenset("idiot moron stupid clown imbecile dumb jerk fool dumm trottel blödmann crétin abruti stupide estúpido imbécil tonto".split())
WORTH = frozenset("loser trash worthless versager minable basura escoria abschaum".split())
DISGUST = frozenset("scum pathetic disgusting filth vermin ekelhaft widerlich ordure répugnant asqueroso".split())
STEMS = ("idiot", "moron", "stupid", "imbecil", "disgust", "patheti", "worthles")
HEADS = frozenset(s[:4] for s in STEMS)
#: Function words of English, of which most words of the lists are; a text that holds ``ENOUGH`` of them is taken to be in it.
FUNCTION_WORDS = frozenset("the of and to in is that was for with on as are it be by this you not have from".split())
ENOUGH = 3
#: In place of a vote: a list has nothing to say of a text in another language. Nats by which that bears towards no, for all lists
#: together, before annotators have judged any such text.
SILENT, ABROAD = -2, 1.5
TASKS = ("low", "toxic")
LABELLERS = {"low": ("symbols", "repeats", "bars", "shouts", "sentences", "letters", "variety", "lone", "annotator"), "toxic": ("mind", "worth", "disgust", "derived", "annotator")}
#: Votes of the heuristics come in one array, those on quality first.
HEURISTICS = {"low": (0, 8), "toxic": (8, 12)}
#: Priors: the share of yes; how often a heuristic, and an annotator, says yes rightly and no rightly; how many votes the former's weigh.
COMMON, HEURISTIC, ANNOTATOR, TRUST = 0.1, (0.5, 0.95), (0.98, 0.99), 5.0
#: Nats; a document on which the votes say less is an example of neither answer.
LEAST = 0.1
PLAIN = frozenset(".,;:!?'\"()-|/\n\r\t «»“”‘’…–—¿¡")
SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
SMALL = re.compile("[a-zß-öø-ÿ]+")
#: Marks that stand alone between spaces.
LONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


def measures(text: str, words: list[str]) -> dict[str, float]:
    """Shares: odd symbols among characters, words equal to the one before, bars and runs of ! among
    words, capitals among letters, distinct words."""
    n = max(1, len(words))
    odd = sum(text.count(c) for c in set(text) - PLAIN if not c.isalnum())
    return {
        "symbols": odd / max(1, len(text)),
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "bars": text.count("|") / n,
        "shouts": max(text.count("!!") / n, len(CAPITAL.findall(text)) / max(1, sum(map(len, words)))),
        "distinct": len(set(words)) / n,
    }


def insults(words: set[str]) -> tuple[int, int, int, int]:
    """Whether there is a word of MIND, of WORTH, of DISGUST, and one derived from a stem that none of them holds."""
    lists = MIND | WORTH | DISGUST
    derived = any(w[:4] in HEADS and w.startswith(STEMS) and w not in lists for w in words)
    return int(not words.isdisjoint(MIND)), int(not words.isdisjoint(WORTH)), int(not words.isdisjoint(DISGUST)), int(derived)


def spoken_here(words: set[str]) -> bool:
    """Whether the text is in the language of the word lists, by its function words."""
    return len(words & FUNCTION_WORDS) >= ENOUGH


def vote(value: float, yes: float, no: float) -> int:
    """Yes from ``yes`` on, no up to ``no``; the other way round if ``yes`` is the smaller."""
    value, yes, no = (value, yes, no) if yes > no else (-value, -yes, -no)
    return 1 if value >= yes else -1 if value <= no else 0


def votes(text: str, found: dict[str, float], signs: tuple[int, ...], n: int, here: bool) -> list[int]:
    """Of the heuristic labellers, in the order of LABELLERS, on a text of ``n`` words, ``here`` saying whether it is in the language
    of the word lists. A text too short for a measure gets no opinion by it."""
    ends, small = len(SENTENCE_END.findall(text)) / max(1, n), sum(map(len, SMALL.findall(text))) / max(1, len(text) - sum(map(text.count, "0123456789")))
    lone = len(LONE.findall(text)) / max(1, n)
    low = [
        vote(found["symbols"], 0.08, 0.02), vote(found["repeats"], 0.3, 0.15), vote(found["bars"], 0.4, 0.15), vote(found["shouts"], 0.5, 0.15) if n >= 3 else 0,
        (vote(ends, 0.3, 0.2) if ends > 0.05 else vote(ends, 0.02, 0.05)) if n >= 20 else 0, vote(small, 0.72, 0.75) if n >= 10 else 0, vote(found["distinct"], 0.3, 0.5) if n >= 30 else 0,
        vote(lone, 0.25, 0.1) if n >= 10 else 0,
    ]
    return low + [1 if sign else -1 if here else 0 if any(signs) else SILENT for sign in signs]


class WordSlots(dict):
    """By word: the slots of the word and of its first 4 and 5 letters, in one number; emptied when it
    holds ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        first, second, third = (xxhash.xxh3_64_intdigest(n) % SLOTS for n in (word, f"^{word[:4]}", f"^{word[:5]}"))
        found = self[word] = first | second << 20 | third << 40
        return found


def features(found: dict[str, float], words: set[str], signs: tuple[int, ...], known: WordSlots) -> np.ndarray:
    """Distinct slots of the document's features: hashed words and their first 4 and 5 letters, then from
    SLOTS on the families, and from HASHED on the levels that each measure reaches, and the signs of insult."""
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    heads, least = np.sort(packed >> 40), max(FAMILY, len(words) // 100) - 1
    families = SLOTS + (heads[least:][heads[least:] == heads[: max(0, len(heads) - least)]] & FAMILIES - 1)
    hashed = np.unique(np.concatenate([packed & 0xFFFFF, packed >> 20 & 0xFFFFF, heads, families]))
    reached = [HASHED + LEVELS * k + i for k, v in enumerate(found.values()) for i in range(min(LEVELS, int(v * LEVELS) + 1))]
    marked = [SIZE - SIGNS + k for k, sign in enumerate(signs) if sign]
    return np.concatenate([hashed.astype(np.int32), np.array(reached + marked, np.int32)])


def _votes_and_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordSlots()
    for batch in slices(batches, 1, 2 << 20):
        cast, slots = [], []
        for text, chosen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            found, own = measures(text or "", words), set(words)
            signs = insults(own)
            cast.append(votes(text, found, signs, len(words), spoken_here(own)) if words else [0] * HEURISTICS["toxic"][1])
            slots.append(features(found, own, signs, known).tobytes() if chosen and words else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cast, pa.list_(pa.int32())), pa.array(slots, pa.binary())], names=["id", "votes", "slots"])


@dataclass(frozen=True)
class LabelModel:
    """How common yes is, and by labeller how often it says yes rightly and no rightly, and the shares of documents on
    which it votes, on which another one votes too, and on which another one says the contrary."""

    common: float
    yes: np.ndarray
    no: np.ndarray
    coverage: np.ndarray
    overlap: np.ndarray
    conflict: np.ndarray


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, LabelModel]:
    """Posterior of each pattern of votes (the annotator's last), and what was estimated of the labellers.

    Given the answer, labellers vote apart from each other, and no opinion says nothing, nor does ``SILENT``. Each labeller's two
    shares begin with ``TRUST`` votes as ``HEURISTIC`` says, the annotator's with as many more as it cast, as
    ``ANNOTATOR`` says; the share of yes with ``TRUST`` documents of which ``COMMON`` are.
    """
    said_yes, said_no = (patterns > 0).astype(float), (patterns == -1).astype(float)
    spoken = said_yes + said_no
    given = np.full(patterns.shape[1], TRUST)
    given[-1] += counts @ spoken[:, -1]
    before = np.array([HEURISTIC] * (patterns.shape[1] - 1) + [ANNOTATOR])
    (yes, no), common = before.T.copy(), COMMON
    for _ in range(rounds):
        odds = np.log(common / (1 - common)) + said_yes @ np.log(yes / (1 - no)) + said_no @ np.log((1 - yes) / no)
        posterior = 1 / (1 + np.exp(-odds))
        is_yes, is_no = counts * posterior, counts * (1 - posterior)
        yes = np.clip((is_yes @ said_yes + given * before[:, 0]) / (is_yes @ spoken + given), 0.001, 0.999)
        no = np.clip((is_no @ said_no + given * before[:, 1]) / (is_no @ spoken + given), 0.001, 0.999)
        yes = np.maximum(yes, 1 - no)  # no labeller is worse than one that says nothing of the answer
        common = (is_yes.sum() + TRUST * COMMON) / (counts.sum() + TRUST)
    others = spoken.sum(axis=1, keepdims=True) - spoken
    against = np.where(patterns > 0, said_no.sum(axis=1, keepdims=True), np.where(patterns == -1, said_yes.sum(axis=1, keepdims=True), 0))
    share = lambda x: counts @ x / max(1.0, counts.sum())
    return posterior, LabelModel(float(common), yes, no, share(spoken), share(spoken * (others > 0)), share((against > 0).astype(float)))


def evidence(posterior: np.ndarray, common: float, silent: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior if yes and no were as likely beforehand, what the votes say in nats: its divergence from one half). A rare
    answer is so not drowned by its rareness, which bears on the labellers' shares alone. ``silent`` is the weight of silence in nats."""
    odds = posterior / np.maximum(1 - posterior, 1e-300) * (1 - common) / common * np.exp(-silent)
    p = np.clip(odds / (1 + odds), 1e-12, 1 - 1e-12)
    return p, p * np.log(2 * p) + (1 - p) * np.log(2 * (1 - p))


class Model:
    """Weights by slot and the intercept, for each task; what was estimated of the labellers for the record."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray, labellers: dict[str, LabelModel]):
        self.weights, self.intercepts, self.labellers = weights, intercepts, labellers


VALUES = np.concatenate([np.full(SLOTS, WEAK), np.full(SIZE - SLOTS, STRONG)])
BIAS, LOSS, WEIGHT = SIZE, SIZE + 1, SIZE + 2


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (slots, number of documents) to (slot, n): the documents that hold each slot."""
    held = np.zeros(SIZE, np.int64)
    for batch in batches:
        for slots, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[np.frombuffer(slots, np.int32)] += n
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["slot", "n"])


def values_of(sample: DataFrame, min_docs: int) -> np.ndarray:
    """Value of each feature: 0 for hashed ones that fewer than ``min_docs`` documents of (slots, n) hold."""
    found = in_arrow(sample.select("slots", "n"), _holders, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(f"n >= {min_docs} or slot >= {HASHED}").toArrow()
    kept = np.zeros(SIZE)
    kept[found.column("slot").to_numpy()] = 1.0
    return VALUES * kept


def _gradient(weights: np.ndarray, values: np.ndarray = VALUES):
    """From (slots as 32-bit numbers, p_low, p_toxic, number of documents, and optionally a document's weights w_low, w_toxic),
    a null p standing for no opinion, to (slot, low, toxic): parts of the gradient by slot, with rows for the intercepts, the
    losses and the weights of documents."""
    scaled = weights[:SIZE] * values[:, None]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE + 3, len(TASKS)))
        for batch in batches:
            packed = batch.column(0).to_pylist()
            slots = np.frombuffer(b"".join(packed), np.int32)
            sizes = np.array([len(x) // 4 for x in packed])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            each = batch.column(len(TASKS) + 1).to_numpy().astype(float)
            for k in range(len(TASKS)):
                given = batch.column(len(TASKS) + 2 + k).to_numpy(zero_copy_only=False).astype(float) if batch.num_columns > len(TASKS) + 2 else 1.0
                times = each * np.nan_to_num(given)
                wanted = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(wanted)
                wanted = np.where(there, wanted, 0.0)
                logs = np.bincount(owner, scaled[slots, k], len(sizes)) + weights[BIAS, k]
                error = np.where(there, 1 / (1 + np.exp(-np.clip(logs, -500, 500))) - wanted, 0.0) * times
                total[:SIZE, k] += np.bincount(slots, error[owner], SIZE) * values
                total[BIAS:, k] += error.sum(), (np.where(there, np.logaddexp(0, logs) - wanted * logs, 0) * times).sum(), times[there].sum()
        at = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(total[part, k]) for k in range(len(TASKS)))], names=["slot", *TASKS])

    return rows


def objective(sample: DataFrame, regularisation: float, values: np.ndarray = VALUES):
    """weights -> (loss, gradient), both as sums of the tasks' means; one Spark job each time. The weights are broadcast, and
    go from the disks of all machines when the job ends; inside the function they would stay until the session does."""

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        weights = flat.reshape(SIZE + 1, len(TASKS))
        sent = sample.sparkSession.sparkContext.broadcast((weights, values))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _gradient(*sent.value)(batches)

        try:
            found = in_arrow(sample, rows, "slot int, low double, toxic double").groupBy("slot").agg(*[F.sum(t).alias(t) for t in TASKS]).toArrow()
        finally:
            sent.destroy(blocking=True)
        total = np.zeros((SIZE + 3, len(TASKS)))
        total[found.column("slot").to_numpy()] = np.stack([found.column(t).to_numpy() for t in TASKS], axis=1)
        n = np.where(total[WEIGHT] > 0, total[WEIGHT], 1)
        gradient = total[: SIZE + 1] / n
        gradient[:SIZE] += regularisation * weights[:SIZE]
        return float((total[LOSS] / n).sum() + regularisation / 2 * (weights[:SIZE] ** 2).sum()), gradient.ravel()

    return at


def minimised(evaluate, start: np.ndarray, rounds: int, tolerance: float = 1e-5, memory: int = 6) -> np.ndarray:
    """L-BFGS with steps that are halved until they help."""
    x, (value, gradient) = start, evaluate(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, held = gradient.copy(), []
        for s, y in reversed(pairs):
            a = s @ way / (s @ y)
            held.append(a)
            way -= a * y
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(pairs, reversed(held), strict=True):
            way += s * (a - y @ way / (s @ y))
        slope, step = float(gradient @ way), 1.0
        while step > 1e-4:
            after, (new_value, new_gradient) = x - step * way, evaluate(x - step * way)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        gain = value - new_value
        if (after - x) @ (new_gradient - gradient) > 1e-12:
            pairs = [*pairs[1 - memory :], (after - x, new_gradient - gradient)]
        x, value, gradient = after, new_value, new_gradient
        if gain < tolerance * max(1.0, abs(value)):
            break
    return x


def _annotated(own: DataFrame, labels: DataFrame | None, id_col: str, low_if: Column | None, toxic_if: Column | None) -> DataFrame:
    """Adds the annotators' votes a_low and a_toxic (0 where there are none)."""
    if labels is None:
        return own.withColumn("a_low", F.lit(0)).withColumn("a_toxic", F.lit(0))

    def vote(condition: Column) -> Column:
        sign = F.when(condition, 1).otherwise(F.when(condition.isNotNull(), -1))
        return F.when(F.min(sign) == F.max(sign), F.min(sign)).otherwise(0)

    one = labels.groupBy(F.col(id_col).alias("id")).agg(vote(low_if).alias("a_low"), vote(toxic_if).alias("a_toxic"))
    return own.join(one, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("a_low", "a_toxic")})


def train(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    low_if: Column | None = None,
    toxic_if: Column | None = None,
    train_rows: int = 30_000,
    regularisation: float = 1e-3,
    rounds: int = 30,
    min_docs: int = 3,
) -> Model:
    """Label models over all documents; scorers over the sample. Small tables alone come to the driver."""
    low_if = F.col("quality") == 0 if low_if is None else low_if
    toxic_if = F.col("toxic") == 1 if toxic_if is None else toxic_if
    total = docs.count()
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_rows / max(1, total)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), chosen.alias("chosen"))
    own = stored(in_arrow(texts, _votes_and_sample, f"id {docs.schema[id_col].dataType.simpleString()}, votes array<int>, slots binary"))
    joined = _annotated(own, labels, id_col, low_if, toxic_if)
    held = stored(joined.select("slots", *[F.array(*[F.col("votes")[i] for i in range(*HEURISTICS[t])], f"a_{t}").alias(t) for t in TASKS]))
    sample, labellers = held.where("slots is not null"), {}
    for task in TASKS:
        rows = held.where(F.exists(F.col(task), lambda v: v != 0)).groupBy(task).count().collect()
        if not rows:
            sample = sample.withColumns({f"{c}_{task}": F.lit(None).cast("double") for c in "pw"})
            continue
        patterns = np.array([r[0] for r in rows])
        posterior, labellers[task] = expectation_maximisation(patterns, np.array([r[1] for r in rows], float))
        silent = (patterns == SILENT).any(axis=1)
        judged = sum(r[1] for r, mute in zip(rows, silent, strict=True) if mute and r[0][-1])
        posterior, said = evidence(posterior, labellers[task].common, silent * ABROAD * TRUST / (TRUST + judged))
        said = np.where(said >= LEAST, said, 0.0)
        spoken = np.array([r[1] for r in rows]) * said
        # the rarer answer weighs more, by the root of the ratio, as the scorer's intercept would else follow its rareness
        said = said * (1 + posterior * (np.sqrt(max(1.0, (spoken @ (1 - posterior)) / max(1e-9, spoken @ posterior))) - 1))
        answers = docs.sparkSession.createDataFrame([(r[0], float(p), float(w)) for r, p, w in zip(rows, posterior, said, strict=True)], f"{task} array<int>, p_{task} double, w_{task} double")
        # at most one row for each pattern of nine votes
        sample = sample.join(F.broadcast(answers), task, "left")
    weights = [f"w_{t}" for t in TASKS]
    counted = sample.groupBy("slots", *[f"p_{t}" for t in TASKS], *weights).agg(F.count("*").alias("n")).select("slots", *[f"p_{t}" for t in TASKS], "n", *weights)
    # the sample has about train_rows rows at most, so a fixed number of partitions holds it
    sample = stored(counted.repartition(3))
    discard(own, held)
    values = values_of(sample, min_docs)
    with tidy(docs.sparkSession):  # the shuffle files of a round go when it ends
        flat = minimised(objective(sample, regularisation, values), np.zeros((SIZE + 1) * len(TASKS)), rounds)
    discard(sample)
    weights = flat.reshape(SIZE + 1, len(TASKS))
    intercepts = np.array([weights[BIAS, k] if t in labellers else -50.0 for k, t in enumerate(TASKS)])
    return Model(weights[:SIZE] * values[:, None], intercepts, labellers)


def _judged(text: str | None, model: Model, known: WordSlots) -> np.ndarray | None:
    """Log odds of the tasks; None for a text without words."""
    words = WORD.findall((text or "").lower())
    if not words:
        return None
    own = set(words)
    return model.intercepts + model.weights[features(measures(text, words), own, insults(own), known)].sum(axis=0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, p_low, p_toxic and keep (both below one half)."""
    names = [id_col, "p_low", "p_toxic"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordSlots()
        for batch in slices(batches, 1, 2 << 20):
            out = np.zeros((batch.num_rows, 2))
            for i, text in enumerate(batch.column(1).to_pylist()):
                logs = _judged(text, model, known)
                out[i] = (1.0, 0.0) if logs is None else 1 / (1 + np.exp(-np.clip(logs, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], names=names)

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    made = in_arrow(own, scored, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, p_low double, p_toxic double")
    return made.withColumn("keep", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the scorer keeps."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordSlots()
        for batch in slices(batches, at, 2 << 20):
            good = []
            for text in batch.column(at).to_pylist():
                logs = _judged(text, model, known)
                good.append(logs is not None and bool((logs < 0).all()))
            yield batch.filter(pa.array(good, pa.bool_()))

    return in_arrow(docs, kept, docs.schema)
