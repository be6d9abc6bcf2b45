"""Language identification (operator 2): word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls back to its character n-grams, the
longest order of which the model knows one, down to single characters; their mean log frequencies are its score.  A
text's language has the highest sum over all words of the whole text; the score is that language's share after a
softmax of the sums divided by the square root of the number of words.

The model is fitted on a sample of about `train_documents` labelled documents, drawn by a hash of doc_id.  Languages
share the sample evenly, and what one of few documents leaves goes to the others, so none is missing beside a large one.
All words of the sample and all their n-grams are kept; the sample bounds what is broadcast, whatever the input's size.
Prediction sees nothing but the text.

`accepted` can also reject what reads like no learned language.  A text's evidence is the sum, over its letters, of the
log of how much more probable the model makes each after the two before it, in the text's language, than chance does
among that language's letters (the most frequent ones, to 99.9 % of all).  Letters at random, keys mashed, scripts and
languages that the model never saw come out at 0 or below, at any length, and go.

Texts that are null or have no letter get `und` and score 0.  Ties go to the language that sorts first.  Without any
labelled document every text is `und`.  Repeated rows are repeated; other columns are ignored by `predict`, and kept
by `accepted`.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.llm._text import chunks

TRAIN_DOCUMENTS = 20_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Words whose scores a worker remembers; when reached, it forgets them all.
REMEMBERED = 200_000
#: Share of a language's letters that those counted for chance make up.
COMMON = 0.999
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    languages: list[str]
    #: Sorted hashes of the known words, and the scores of each in the languages; the same of n-grams.
    word_keys: np.ndarray = None
    word_scores: np.ndarray = None
    gram_keys: np.ndarray = None
    gram_scores: np.ndarray = None
    #: Evidence of each n-gram of 3, and of an unseen one after each n-gram of 2.
    follows: dict[str, int] = field(default_factory=dict)
    follow_gains: np.ndarray = None
    contexts: dict[str, int] = field(default_factory=dict)
    context_gains: np.ndarray = None

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]]) -> Model:
        """From (language, word, count) rows."""
        languages = sorted({x[0] for x in counts})
        at = {x: i for i, x in enumerate(languages)}
        short: list[Counter] = [Counter() for _ in languages]  # n-grams of up to 3

        def gram_counts():
            for order in ORDERS:  # one order at a time is held
                by_gram: list[Counter] = [Counter() for _ in languages]
                for lang, word, n in counts:
                    own = by_gram[at[lang]]
                    for g in grams(word, order):
                        own[g] += n
                for k, own in enumerate(by_gram):
                    for g, n in own.items():
                        yield g, k, n
                    if order <= 3:
                        short[k].update(own)

        model = cls(languages)
        model.word_keys, model.word_scores = _scores(((w, at[x], n) for x, w, n in counts), len(languages))
        model.gram_keys, model.gram_scores = _scores(gram_counts(), len(languages))
        model._set_gains(short)
        return model

    def _set_gains(self, by_gram: list[Counter]) -> None:
        chance = np.array([_common_letters(own) + 1.0 for own in by_gram])  # with the end of a word
        count = lambda g: np.array([own[g] for own in by_gram], dtype=float)
        gain = lambda n, before: np.log((n + 0.5) * chance / (before + 0.5 * chance))
        kinds = {g: len(g) for own in by_gram for g in own if len(g) in (2, 3)}
        pairs = [g for g, n in kinds.items() if n == 2 and g[-1] != "_"]
        triples = [g for g, n in kinds.items() if n == 3]
        self.contexts, self.follows = {g: i for i, g in enumerate(pairs)}, {g: i for i, g in enumerate(triples)}
        none = np.zeros((0, len(by_gram)))
        self.context_gains = np.array([gain(0.0, count(g)) for g in pairs]) if pairs else none
        self.follow_gains = np.array([gain(count(g), count(g[:2])) for g in triples]) if triples else none

    def evidence(self, word: str) -> np.ndarray:
        """In each language; letters after two that were never seen have none."""
        total = np.zeros(len(self.languages))
        for g in grams(word, 3):
            if (i := self.follows.get(g)) is not None:
                total += self.follow_gains[i]
            elif (i := self.contexts.get(g[:2])) is not None:
                total += self.context_gains[i]
        return total

    def unseen(self, word: str) -> np.ndarray:
        for order in ORDERS:
            rows = _rows(self.gram_keys, grams(word, order))
            if (known := rows[rows >= 0]).size:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.languages))


def _common_letters(own: Counter) -> int:
    """How many of the most frequent letters make up COMMON of all."""
    amounts = np.array(sorted((n for g, n in own.items() if len(g) == 1), reverse=True), dtype=float)
    return int(np.searchsorted(amounts.cumsum(), COMMON * amounts.sum())) + 1


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def _rows(keys: np.ndarray, strings: list[str]) -> np.ndarray:
    """The place of each string's hash in `keys`, or -1."""
    wanted = np.fromiter(map(_key, strings), np.uint64, len(strings))
    if not len(keys):
        return np.full(len(strings), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _scores(rows, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the keys in rows (key, language, count), and their smoothed log frequency in each language."""
    hashes, at, amounts = array("Q"), array("q"), array("d")
    for key, k, n in rows:
        hashes.append(_key(key))
        at.append(k)
        amounts.append(n)
    if not at:
        return np.zeros(0, np.uint64), np.zeros((0, languages))
    keys, place = np.unique(np.frombuffer(hashes, np.uint64), return_inverse=True)
    counts = np.bincount(place * languages + np.frombuffer(at, np.int64), np.frombuffer(amounts), len(keys) * languages).reshape(-1, languages)
    return keys, np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * len(counts))


class Predictor:
    def __init__(self, model: Model):
        self.model, self.memory = model, {}
        self.scores = np.zeros((0, len(model.languages)))
        self.gains, self.known_gains = np.zeros((0, len(model.languages))), np.zeros(0, dtype=bool)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of `scores` for some words."""
        memory, model = self.memory, self.model
        new = [w for w in dict.fromkeys(words) if w not in memory]
        if new:
            base = len(memory)
            if base + len(new) > len(self.scores):
                grown = np.zeros((max(base + len(new), 2 * len(self.scores)), len(model.languages)))
                grown[:base] = self.scores[:base]
                self.scores = grown
            for j, (w, i) in enumerate(zip(new, _rows(model.word_keys, new).tolist(), strict=True), base):
                memory[w] = j
                self.scores[j] = model.word_scores[i] if i >= 0 else model.unseen(w)
        return np.array([memory[w] for w in words], dtype=np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged(text, False)[:2]

    def judged(self, text: str | None, evidence: bool = True) -> tuple[str, float, float]:
        """Language, score, and evidence that the text reads like that language."""
        words = words_of(text)
        if not self.model.languages or not has_letter(words):
            return UNKNOWN, 0.0, 0.0
        if len(self.memory) > REMEMBERED:
            self.memory = {}
            self.known_gains[:] = False
        rows = self.rows(words)
        total = self.scores[rows].sum(axis=0)
        z = (total - total.max()) / np.sqrt(len(words))
        p = np.exp(z)
        k = int(p.argmax())
        return self.model.languages[k], float(p[k] / p.sum()), self.evidence(words, rows, k) if evidence else 0.0

    def evidence(self, words: list[str], rows: np.ndarray, k: int) -> float:
        size = len(self.scores)
        if size > len(self.gains):
            gains, known = np.zeros((size, len(self.model.languages))), np.zeros(size, dtype=bool)
            gains[: len(self.gains)], known[: len(self.gains)] = self.gains, self.known_gains
            self.gains, self.known_gains = gains, known
        for at in np.flatnonzero(~self.known_gains[rows]).tolist():
            if not self.known_gains[rows[at]]:
                self.gains[rows[at]] = self.model.evidence(words[at])
                self.known_gains[rows[at]] = True
        return float(self.gains[rows, k].sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shares(rows: dict[str, int], most: int) -> dict[str, int]:
    """How many of its rows each language gives to a sample of `most`: an even share, or all where it has fewer."""
    taken, left = {}, most
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        taken[lang] = min(n, max(1, left // (len(rows) - k)))
        left -= taken[lang]
    return taken


def train(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    fold = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = {r["lang"]: r["count"] for r in fold.groupBy("lang").count().collect()}
    if sum(labelled.values()) > train_documents:
        taken = shares(labelled, train_documents)
        of = lambda x: F.create_map(*[F.lit(v) for pair in x.items() for v in pair])[F.col("lang")]
        fold = fold.where(F.pmod(F.xxhash64("doc_id"), of(labelled)) < of(taken))

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for part in chunks(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts.update((lang, w) for w in words_of(text))
            if counts:
                langs, words = zip(*counts, strict=True)
                yield pa.record_batch([pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    rows = fold.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    return Model.fit(list(zip(*[found.column(c).to_pylist() for c in ("lang", "word", "n")], strict=True)))


def _predicted(docs: DataFrame, model: Model, columns, schema, evidence: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [predictor.judged(t, evidence) for t in part.column("text").to_pylist()]
                yield columns(part, *[pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`."""

    def columns(part, lang, score, _):
        return pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("held_out"), lang, score], names=["doc_id", "held_out", "lang_pred", "score"])

    return _predicted(docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")), model, columns, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, least: float = 0.0, like_language: bool = False) -> DataFrame:
    """Rows of `docs`, all columns kept, whose language is one of `languages` (any known) with score `least` or more;
    with `like_language` only those with evidence above 0 for it."""

    def columns(part, lang, score, evidence):
        import pyarrow.compute as pc

        keep = pc.and_(pc.not_equal(lang, UNKNOWN), pc.greater_equal(score, least))
        if languages is not None:
            keep = pc.and_(keep, pc.is_in(lang, pa.array(languages, pa.string())))
        if like_language:
            keep = pc.and_(keep, pc.greater(evidence, 0.0))
        return part.filter(keep)

    return _predicted(docs, model, columns, docs.schema, like_language)
