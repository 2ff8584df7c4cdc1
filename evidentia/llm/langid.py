"""Language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public vocabulary, all of them. Training counts pieces for each language
over all labelled documents: the distinct words of a batch are segmented greedily (longest piece
first), and only (language, piece, count) rows are shuffled. Each language's piece probabilities are
smoothed over the whole vocabulary. To score a word, a forward pass over its bytes sums the
probabilities of all its segmentations under each language; a text's score is the sum over its words
of the log of that, and the languages' posterior follows from it.

A word is a run of letters, lower-cased, with a space before it. A run of more than ``RUN`` letters,
as in scripts that do not part words, is cut after every ``RUN`` letters, and the parts count as words
that no space begins. Many words pass through the trie of the vocabulary and the recurrence at once.

The model has (languages x vocabulary) numbers: it grows with neither the documents nor their
length. Of ``at_once`` languages at a time a matrix is held in a task; more of them make as many passes,
whose results are joined row by row.

Edge cases: a null text or one without a letter is ``und`` with score 0; documents with a null
language or text teach nothing; with no training rows every text is ``und``; ties go to the language
that sorts first; repeated rows are scored row by row; other columns are never read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import by_bytes, in_arrow, slices, texts_of
from evidentia.llm.byte_bpe import load_ranks
from evidentia.llm.pieces import Pieces, forward, greedy
from evidentia.llm.tables import discard, stored

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RUN = 64
WORDS = re.compile(r"[^\W\d_]+")
#: Of the words that a worker remembers: how many, and their letters.
MOST_WORDS, MOST_LETTERS = 800_000, 24_000_000
INSIDE = "\0"


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@lru_cache(maxsize=2)
def _pieces(vocabulary: str) -> Pieces:
    return Pieces(load_ranks(vocabulary))


def _prepared(text: str) -> Counter:
    """Counts of the text's words, lower-cased. The parts of a long run after its first begin with INSIDE."""
    found = Counter(WORDS.findall(text.lower()))
    for run in [w for w in found if len(w) > RUN]:
        n = found.pop(run)
        found[run[:RUN]] += n
        for a in range(RUN, len(run), RUN):
            found[INSIDE + run[a : a + RUN]] += n
    return found


def _code(word: str) -> bytes:
    return word[1:].encode() if word[0] == INSIDE else b" " + word.encode()


def piece_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(lang, piece, n) over all rows of which neither language nor text is null; piece -1: documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(vocabulary)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}
        documents: Counter = Counter()
        letters = 0

        def settle() -> None:
            for lang, own in words.items():
                total = sums.setdefault(lang, np.zeros(int(known.id_of.max()) + 1, np.int64))
                keys, times = [_code(w) for w in own], np.fromiter(own.values(), np.int64, len(own))
                for a, b in by_bytes([len(w) for w in keys], 1 << 20):
                    owner, ids = greedy(keys[a:b], known)
                    total += np.bincount(ids, times[a:b][owner], len(total)).astype(np.int64)
            words.clear()

        for batch in slices(batches, 1, 4 << 20):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words.setdefault(lang, Counter()).update(_prepared(text))
                documents[lang] += 1
                letters += len(text)
            if letters > 2 * MOST_LETTERS or sum(map(len, words.values())) > MOST_WORDS:
                settle()
                letters = 0
        settle()
        for lang, n in documents.items():
            ids = np.flatnonzero(sums[lang]) if lang in sums else np.zeros(0, np.int64)
            counts = [n, *sums[lang][ids].tolist()] if lang in sums else [n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array([-1, *ids.tolist()], pa.int32()), pa.array(counts, pa.int64())], names=["lang", "piece", "n"])

    kept = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("__text"))
    return in_arrow(kept, counted, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages, log priors and piece probabilities, in parts of so many languages as are held at once."""

    def __init__(self, parts: list[tuple[list[str], np.ndarray, np.ndarray]], vocabulary: str):
        self.parts, self.vocabulary = parts, vocabulary


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", vocabulary: str = VOCABULARY, smoothing: float = 0.1, at_once: int = 200) -> Model:
    """Learns from all rows of ``df``; only the sums by language and piece come to the driver, ``at_once`` languages at a time."""
    rows = stored(piece_counts(df, lang_col, text_col, vocabulary))
    documents = {r.lang: r.n for r in rows.where("piece = -1").select("lang", "n").collect()}
    languages, total, parts = sorted(documents), sum(documents.values()) + len(documents), []
    for a in range(0, len(languages), at_once):
        own = languages[a : a + at_once]
        chosen = rows.where("piece >= 0")
        found = (chosen if len(own) == len(languages) else chosen.where(F.col("lang").isin(own))).toArrow()
        lang = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
        place = {name: k for k, name in enumerate(own)}
        at = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()] if found.num_rows else np.zeros(0, np.int64)
        smooth = np.full((int(_pieces(vocabulary).id_of.max()) + 1, len(own)), smoothing)
        smooth[found.column("piece").to_numpy(), at] += found.column("n").to_numpy()
        parts.append((own, np.log([(documents[x] + 1) / total for x in own]), smooth / smooth.sum(axis=0)))
    discard(rows)
    return Model(parts, vocabulary)


class _Scores:
    """Scores of the words met so far under some languages; begins anew when it holds too much."""

    def __init__(self, name: str, probabilities: np.ndarray, vocabulary: str):
        self.name, self.probabilities, self.pieces = name, probabilities, _pieces(vocabulary)
        self.most = min(MOST_WORDS, 6_400_000 // probabilities.shape[1])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.rows = np.zeros((0, self.probabilities.shape[1]))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.at]
        letters = sum(map(len, fresh))
        if self.at and (len(self.at) + len(fresh) > self.most or self.letters + letters > MOST_LETTERS):
            self.clear()
            fresh, letters = list(words), sum(map(len, words))
        self.letters += letters
        codes = [_code(w) for w in fresh]
        made = [forward(codes[a:b], self.pieces, self.probabilities) for a, b in by_bytes([len(c) for c in codes], 2_000_000 // self.probabilities.shape[1])]
        self.at.update({w: len(self.rows) + i for i, w in enumerate(fresh)})
        self.rows = np.vstack([self.rows, *made])

    def total(self, words: Counter) -> np.ndarray:
        """Sum over the words, each as often as it stands."""
        counts = np.fromiter(words.values(), float, len(words))
        return counts @ self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


_LATEST: list[_Scores] = []


def _scores_of(name: str, probabilities: np.ndarray, vocabulary: str) -> _Scores:
    """The worker's scores under these languages, which tasks of one worker share."""
    if not _LATEST or _LATEST[0].name != name:
        _LATEST[:] = [_Scores(name, probabilities, vocabulary)]
    return _LATEST[0]


def _pass(part: tuple[list[str], np.ndarray, np.ndarray], vocabulary: str, text: int):
    """From rows with the text and, behind it, (best language, its log score, log of the sum of all scores)
    so far to the same rows after the languages of ``part``."""
    languages, priors, probabilities = part
    name = uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _scores_of(name, probabilities, vocabulary)
        for batch in slices(batches, text, 4 << 20):
            texts = texts_of(batch.column(text))
            counts = [_prepared(t) for t in texts]
            known.learn(set().union(*counts))
            best, log, total = (batch.column(text + 1 + i).to_pylist() for i in range(3))
            for i, words in enumerate(counts):
                if not any(map(str.isalpha, texts[i])):
                    continue
                logs = priors + known.total(words)
                k = int(np.argmax(logs))
                if log[i] is None or logs[k] > log[i]:
                    best[i], log[i] = languages[k], float(logs[k])
                own = float(np.logaddexp.reduce(logs))
                total[i] = own if total[i] is None else float(np.logaddexp(total[i], own))
            made = [pa.array(best, pa.string()), pa.array(log, pa.float64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: text + 1], *made], names=batch.schema.names)

    return scored


def identify(df: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Per row: ``id_cols``, lang_pred and score (the posterior of that language; 0 for und)."""
    none = F.lit(None)
    now = df.select(*id_cols, F.col(text_col).cast("string").alias("__text"), none.cast("string").alias("__best"), none.cast("double").alias("__log"), none.cast("double").alias("__sum"))
    for part in model.parts:
        now = in_arrow(now, _pass(part, model.vocabulary, len(id_cols)), now.schema)
    score = F.coalesce(F.least(F.lit(1.0), F.exp(F.col("__log") - F.col("__sum"))), F.lit(0.0))
    return now.select(*id_cols, F.coalesce("__best", F.lit("und")).alias("lang_pred"), score.alias("score"))


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Trains on the documents outside fold 0 and predicts all: ``id_col``, held_out, lang_pred, score."""
    model = train(docs.where(fold_of(id_col, folds) != 0), lang_col, text_col)
    return identify(docs, model, [id_col], text_col).select(id_col, (fold_of(id_col, folds) == 0).alias("held_out"), "lang_pred", "score")
