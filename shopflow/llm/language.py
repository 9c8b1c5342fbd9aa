"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three
characters, letters in lower case, every run of other characters one blank).
A document's most frequent n-grams are ranked likewise; its distance to a
profile is the sum of the places by which ranks differ, an n-gram missing from
the profile counting as the profile's length. The nearest language wins; the
score is one minus the mean displacement relative to the profile's length.

Profiles are fitted on all rows of known language up to ``fit_rows`` per
language, beyond that on the fraction of them, chosen by hash, that gives about
so many. Every document is ranked over its whole text.

Defined results: null texts and texts without letters are ``und`` with score 0,
as is every text where no language is known. Equal distances go to the language
that sorts first, equal counts to the n-gram that sorts first. Repeated rows are
judged each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.fitting import hashed_fraction, remainder
from shopflow.llm.store import bounded_batches, tidied

UNKNOWN = "und"
HOLD_OUT = 4
#: Rows per language that a profile is fitted on, about, at most.
FIT_ROWS = 3_000
#: N-grams of a profile, and of a document's ranking.
PROFILE = 400
#: Characters counted at a time; the counts of a longer text are added up.
PIECE = 1 << 18
_BITS = np.int64(21)

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False
                                for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-case letters with one blank (32) for each run of anything else, and
    around the whole; empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate(([32], c[keep], [32] * int(letter[-1]))).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    for at in range(0, len(text), PIECE):
        yield text[at:at + PIECE]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts), each n-gram packed into one number, ordered by it."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in _pieces(text):
        c = code_points(piece)
        if not len(c):
            continue
        two = (c[:-1] << _BITS) | c[1:]
        three = (two[:-1] << _BITS) | c[2:]
        own = np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))
        own.sort()
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        new, n = own[edge[:-1]], np.diff(edge)
        if not len(grams):
            grams, counts = new, n
        else:
            grams, place = np.unique(np.concatenate((grams, new)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(grams)).astype(np.int64)
    return grams, counts


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, in order."""
    if len(grams) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ranks of the n-grams in each language's profile."""

    def __init__(self, ranked: dict[str, list[int]], k: int = PROFILE):
        self.k = k
        self.languages = sorted(ranked)
        self.grams = np.unique(np.concatenate(
            [np.asarray(ranked[x], np.int64) for x in self.languages])
            if self.languages else np.zeros(0, np.int64))
        # A last row stands for n-grams in no profile.
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for j, x in enumerate(self.languages):
            own = np.asarray(ranked[x], np.int64)
            self.ranks[np.searchsorted(self.grams, own), j] = np.arange(len(own))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Mean displacement to each language, relative to the profile's length."""
        at = np.searchsorted(self.grams, ranked)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == ranked, at, len(self.grams)) if len(self.grams) else at
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.k, np.abs(ranks - np.arange(len(ranked))[:, None]))
        return apart.mean(axis=0) / self.k

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        ranked = most_frequent(*gram_counts(text), self.k)
        if not len(ranked):
            return UNKNOWN, 0.0
        d = self.distances(ranked)
        best = int(np.argmin(d))
        return self.languages[best], float(1.0 - d[best])


def _count_grams(batches):
    """(lang, gram, n) summed per batch and language."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_lang.setdefault(lang, []).append(text.as_py() or "")
        langs, grams, counts = [], [], []
        for lang, texts in by_lang.items():
            held: list[str] = []
            size = 0
            for i, text in enumerate(texts):
                held.append(text)
                size += len(text)
                if size >= PIECE or i + 1 == len(texts):
                    g, n = gram_counts("\n".join(held))
                    langs += [lang] * len(g)
                    grams.append(g)
                    counts.append(n)
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()),
             pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)),
             pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))],
            ["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS, k: int = PROFILE) -> Profiles:
    """Profiles of the languages of rows whose crc32(id as text) mod 4 is not 2."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                        F.col(text_col).alias("text")) \
        .where(F.col("lang").isNotNull() & (remainder(F.col("id"), HOLD_OUT) != 2))
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return Profiles({}, k)
    part = spark.createDataFrame([(r["lang"], min(1.0, fit_rows / r["count"])) for r in sizes],
                                 "lang string, part double")
    rows = hashed_fraction(known.join(F.broadcast(part), "lang"), "id", F.col("part"))
    counted = rows.select("lang", "text").mapInArrow(tidied(_count_grams), "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("place", place).where(F.col("place") <= k) \
            .orderBy("lang", "place").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, k)


def _predict_rows(profiles: Profiles):
    def run(batches):
        for batch in batches:
            got = [profiles.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text"
             ) -> DataFrame:
    """(id_col, lang_pred, score) for every row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidied(_predict_rows(profiles)),
                    f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double") \
        .withColumnRenamed("id", id_col)
