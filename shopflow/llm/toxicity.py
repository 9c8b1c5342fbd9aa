"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding (one character to one): lower case, look-alike letters of other scripts
to Latin ones, digits to the letters they stand in for, and l to i (both are
written 1). The lexicon is learned from labelled rows: beginnings of words that
stand far more often in toxic rows than in others, each weighted by the log
ratio of the two rates. Copies of one text count as one row for that. One automaton holds lexicon and exceptions; a match
counts only at the start of a word, and not inside an exception (given phrases,
and words learned to be harmless although they begin like a lexicon entry). The
summed weight per hundred words goes through a logistic curve fitted to the same
rows.

Fitting takes all labelled rows up to ``fit_rows``, beyond that the fraction of
them, chosen by hash, that gives about so many. Every text is scored, whole.

Defined results: null and empty texts have no match and get the curve's value at
zero. Without labelled rows of both classes a small fixed lexicon and curve are
used. Repeated rows and ids are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.fitting import hashed_fraction, remainder
from shopflow.llm.store import bounded_batches, tidied

#: Labelled rows that a lexicon is fitted on, about, at most.
FIT_ROWS = 20_000
HOLD_OUT = 5
STEM_LENGTHS = range(3, 9)
#: Part of the toxic rows that a lexicon entry must occur in, and so many rows.
LEAST_SHARE, LEAST_ROWS = 0.005, 5
#: Log ratio of its rates in toxic and other rows, at least, and at most.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 8.0
#: Standard errors by which its shares of toxic and of other rows differ.
LEAST_Z = 5.0
#: Places to which densities are rounded for fitting the curve.
DENSITY_DIGITS = 3
#: Different surroundings (the words before and after) that an entry has in toxic
#: texts, relative to the number of different texts.
LEAST_VARIETY = 0.7

# Characters drawn like Latin letters, and the letters meant.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
          "@": "a", "$": "s", "|": "i"}
# Used where no labelled rows are at hand.
PLAIN_LEXICON = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "scum": 4.0, "loser": 3.0,
                 "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "trash": 3.0, "clown": 3.0}
# Phrases in which lexicon words are meant harmlessly.
EXCEPTION_PHRASES = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown",
                     "scum line", "pond scum")


def _fold_table() -> dict[int, str]:
    table = {}
    # Full-width and mathematical letters.
    for c in [*range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D6A4)]:
        plain = unicodedata.normalize("NFKC", chr(c)).lower()
        if len(plain) == 1 and "a" <= plain <= "z":
            table[c] = plain
    table |= {ord(k): v for k, v in (LOOK_ALIKES | DIGITS).items()}
    table[ord("l")] = "i"
    return {k: ("i" if v == "l" else v) for k, v in table.items()}


_FOLD = _fold_table()


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def words_of(folded: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in folded).split()


@dataclass
class Model:
    """Lexicon (folded beginning or " word " -> weight), exceptions, and the curve."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTION_PHRASES
    intercept: float = -2.0
    slope: float = 2.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            safe = {fold(x) for x in self.exceptions}
            for entry in safe | self.lexicon.keys():
                found.add_word(entry, (len(entry), self.lexicon.get(entry), entry in safe))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """(summed weight, matches, words) of a text."""
        if not text:
            return 0.0, 0, 0
        folded = fold(text)
        n_words = len(folded.split())
        found = self.automaton()
        if not len(found):
            return 0.0, 0, n_words
        hits, safe = [], []
        for end, (length, weight, harmless) in found.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalnum():
                continue
            if harmless and (end + 1 == len(folded) or not folded[end + 1].isalnum()):
                safe.append((start, end))
            if weight is not None:
                hits.append((start, end, weight))
        if safe:
            longest = max(end - start for start, end in safe)
            hits = [h for h in hits if not _within(h, safe, longest)]
        best = {}
        for start, _, weight in hits:
            best[start] = max(weight, best.get(start, 0.0))
        return math.fsum(best.values()), len(best), n_words

    def score(self, weight: float, n_words: int) -> float:
        return float(_curve(self.intercept + self.slope * _density(weight, n_words)))


def _within(hit, safe, longest) -> bool:
    """Whether one of the (ordered, by end) harmless spans, of ``longest`` characters at
    most, covers the hit."""
    lo, hi = 0, len(safe)
    while lo < hi:
        mid = (lo + hi) // 2
        if safe[mid][1] < hit[1]:
            lo = mid + 1
        else:
            hi = mid
    while lo < len(safe) and safe[lo][1] - longest <= hit[0]:
        if safe[lo][0] <= hit[0]:
            return True
        lo += 1
    return False


def _density(weight, n_words):
    return np.log1p(100.0 * np.asarray(weight) / (np.asarray(n_words) + 10.0))


def _curve(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


_COUNTS = "entry string, t_rows long, t_uses long, c_rows long, c_uses long"


#: Entries counted before a task hands their counts on.
HELD_ENTRIES = 100_000


def _count_entries(batches):
    """The rows that hold an entry and its uses, in toxic (t) and other (c) rows,
    summed over some rows at a time. Entries: beginnings of words, and whole words
    (a blank after them); the empty entry counts the words."""
    rows, uses = (Counter(), Counter()), (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                               strict=True):
            words = Counter(words_of(fold(text or "")))
            own = Counter({"": sum(words.values())})
            for w, n in words.items():
                if len(w) < STEM_LENGTHS.start or w.isdigit():
                    continue
                own[w + " "] += n
                for size in STEM_LENGTHS:
                    if size <= len(w):
                        own[w[:size]] += n
            rows[toxic].update(own.keys())
            uses[toxic].update(own)
            if len(rows[0]) + len(rows[1]) > HELD_ENTRIES:
                yield _counted(rows, uses)
                rows, uses = (Counter(), Counter()), (Counter(), Counter())
    yield _counted(rows, uses)


def _counted(rows, uses):
    entries = list(rows[0].keys() | rows[1].keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(entries, pa.string())] + [pa.array([x[e] for e in entries], pa.int64())
                                            for t in (1, 0) for x in (rows[t], uses[t])],
        ["entry", "t_rows", "t_uses", "c_rows", "c_uses"])


def _surroundings(stems: frozenset[str]):
    """Rows (entry, around): each use of a stem with a hash of the words beside it."""
    def run(batches):
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                words = ["", *words_of(fold(text or "")), ""]
                for before, w, after in zip(words, words[1:], words[2:], strict=False):
                    for size in STEM_LENGTHS:
                        if w[:size] in stems and size <= len(w):
                            seen.add((w[:size], zlib.crc32(f"{before} {after}".encode())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([e for e, _ in seen], pa.string()),
                 pa.array([x for _, x in seen], pa.int64())], ["entry", "around"])
    return run


def choose_lexicon(stems: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Lexicon (entry -> weight) from all good stems (stem -> toxic rows, weight):
    the telling ones first, none that begins another or begins with it."""
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for e in sorted(stems, key=lambda e: (-stems[e][1] * math.sqrt(stems[e][0]), -len(e), e)):
        if e in begun or any(e[:n] in kept for n in range(1, len(e) + 1)):
            continue
        kept[e] = min(MOST_WEIGHT, stems[e][1])
        begun.update(e[:n] for n in range(1, len(e)))
    return kept


def fit_curve(density: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a small ridge; ``rows`` counts the
    rows of each density and label."""
    x = np.column_stack([np.ones(len(toxic)), density])
    b = np.zeros(2)
    for _ in range(50):
        p = _curve(x @ b)
        grad = x.T @ (rows * (toxic - p)) - 0.1 * b
        hess = (x * (rows * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 1e-6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows whose crc32(id as text) mod 5 is not 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")) \
        .where(F.col("toxic").isin(0, 1) & (remainder(F.col("id"), HOLD_OUT) != 0)).distinct()
    total = own.count()
    chosen = hashed_fraction(own, "id", F.lit(min(1.0, fit_rows / max(1, total))))
    # About fit_rows rows of twelve bytes at most, one per id and label: a bounded side.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(chosen), "id").select("text", "toxic")
    # Copies of a text tell once: rows and uses are counted over different texts.
    texts = rows.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["digest", "toxic"]) \
        .select("text", "toxic").persist(StorageLevel.DISK_ONLY)
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    plain = Model({fold(k): w for k, w in PLAIN_LEXICON.items()})
    if not n1 or not n0:
        texts.unpersist()
        return plain
    counts = texts.mapInArrow(tidied(_count_entries), _COUNTS).groupBy("entry").agg(
        *[F.sum(c).alias(c) for c in ("t_rows", "t_uses", "c_rows", "c_uses")]).persist()
    # A toxic row holds a bounded number of entries on average, so entries in a
    # fixed share of the toxic rows are at most that number over the share.
    words = counts.where("entry = ''").first()
    least = max(LEAST_ROWS, LEAST_SHARE * n1)
    weight = (F.log((F.col("t_uses") + 0.5) / (words["t_uses"] + 1))
              - F.log((F.col("c_uses") + 0.5) / (words["c_uses"] + 1)))
    p1, p0, p = F.col("t_rows") / n1, F.col("c_rows") / n0, (F.col("t_rows") + F.col("c_rows")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    good = counts.where("entry not like '% ' and entry <> ''").where(
        (F.col("t_rows") >= least) & (p < 1) & (z >= LEAST_Z)).withColumn("weight", weight) \
        .where(F.col("weight") >= LEAST_WEIGHT).select("entry", "t_rows", "weight").collect()
    around = {r["entry"]: r["n"] for r in texts.where("toxic = 1").mapInArrow(
        _surroundings(frozenset(r["entry"] for r in good)), "entry string, around long")
        .groupBy("entry").agg(F.countDistinct("around").alias("n")).collect()}
    texts.unpersist()
    lexicon = choose_lexicon({r["entry"]: (r["t_rows"], r["weight"]) for r in good
                              if around.get(r["entry"], 0) >= max(least, LEAST_VARIETY * r["t_rows"])})
    if not lexicon:
        counts.unpersist()
        return plain
    # Whole words that begin like an entry but occur in other rows.
    begins = spark.createDataFrame([(k,) for k in lexicon], "stem string")
    odd = counts.where("entry like '% ' and c_rows >= 3 and c_rows > t_rows") \
        .withColumn("stem", F.explode(F.array(
            *[F.substring("entry", 1, n) for n in STEM_LENGTHS]))) \
        .join(F.broadcast(begins), "stem", "left_semi").select("entry").distinct().collect()
    counts.unpersist()
    model = Model(lexicon, EXCEPTION_PHRASES + tuple(sorted(r["entry"].strip() for r in odd)))
    # The curve is fitted to a histogram of densities, a few thousand rows at most.
    seen = rows.mapInArrow(tidied(_weigh_rows(model)), "density double, toxic int") \
        .groupBy("density", "toxic").count().collect()
    x, t, n = (np.array(v, float) for v in zip(*seen, strict=True))
    model.intercept, model.slope = fit_curve(x, t, n)
    return model


def _weigh_rows(model: Model):
    def run(batches):
        for batch in batches:
            got = [model.weigh(t) for t in batch.column(0).to_pylist()]
            density = _density([g[0] for g in got], [g[2] for g in got]).round(DENSITY_DIGITS)
            yield pa.RecordBatch.from_arrays([pa.array(density, pa.float64()), batch.column(1)],
                                             ["density", "toxic"])
    return run


def _score_rows(model: Model):
    def run(batches):
        for batch in batches:
            got = [model.weigh(t.as_py()) for t in batch.column(0)]
            weight = np.array([g[0] for g in got], float)
            words = np.array([g[2] for g in got], np.int64)
            score = _curve(model.intercept + model.slope * _density(weight, words))
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(weight), pa.array([g[1] for g in got], pa.int64()),
                                       pa.array(score)],
                batch.schema.names + ["toxic_weight", "toxic_matches", "toxic_score"])
    return run


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_weight, toxic_matches and toxic_score (0 to 1)."""
    bounded_batches(docs.sparkSession)
    out = ["toxic_weight", "toxic_matches", "toxic_score"]
    names = docs.columns
    # Positional names: other columns may have any name, also these.
    plain = docs.select(F.col(f"`{text_col}`").alias("text"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    scored = plain.mapInArrow(tidied(_score_rows(model)), schema + ", toxic_weight double, "
                              "toxic_matches long, toxic_score double")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in out],
                         *out)
