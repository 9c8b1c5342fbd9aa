"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Base spans per kind, leftmost and without overlap: ``assign`` (a value given to a
name like password or token), ``access`` (access key ids), ``hex`` (long
hexadecimal runs). The test adds ``random``: runs of at least ``RANDOM_LENGTH``
letters, digits and ``+/_=-`` that get few characters per token under a byte-level
BPE vocabulary, as text that the vocabulary has never seen does. Measured are the
whole run, its long parts between signs, and stretches of ``WINDOW`` characters;
of identifiers (short words and numbers joined by signs) and runs without a digit
only the parts with letters, without the signs. Left out of it: digests
(hexadecimal runs of a digest's length), UUIDs, numbers, and runs that a base span
touches.

Spans are code points, end exclusive, of whole texts. Defined results: null and
empty texts have none. Repeated rows are scanned each. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import bounded_batches, tidied
from shopflow.llm.tokens import encoder

KINDS = ("assign", "access", "hex", "random")
RANDOM_LENGTH = 20
#: Characters per token below which a run counts as random.
RATIO = 2.2
#: A run is measured in stretches of so many characters.
STRETCH = 512

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Hexadecimal lengths of common digests (MD5, SHA-1, SHA-2).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RANDOM_LENGTH)
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
HEXADECIMAL_PART = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SIGNS = re.compile(r"[+/_=-]+")
#: An identifier's parts: short words and numbers, or a word and a short number.
PART = re.compile(r"[A-Za-z]{0,16}|[0-9]{1,8}|[A-Za-z]{1,16}[0-9]{1,4}")
#: Of an identifier, parts of so many characters at least are measured, if they
#: have so many together.
LEAST_PART, LEAST_PARTS = 3, 16
#: A stretch of a readable run is so long, begins every few characters, and is
#: random below its own ratios (letters only: the lower one).
WINDOW, STEP, WINDOW_RATIO, LETTERS_RATIO = 24, 4, 1.85, 1.7


def _digest(part: str) -> bool:
    return len(part) in DIGEST_LENGTHS and HEXADECIMAL.fullmatch(part) is not None


def _parts_ratio(text: str, enc, least: int = 1) -> tuple[float, int]:
    """Characters per token of the parts between signs, and their characters."""
    parts = [p for p in SIGNS.split(text) if len(p) >= least and not p.isdigit()]
    n = sum(map(len, parts))
    return n / max(1, sum(len(enc.encode_ordinary(p)) for p in parts)), n


def _is_random(run: str, enc, ratio: float) -> bool:
    """Of a run, or one part of it, as a whole."""
    if run.isdigit() or UUID.fullmatch(run) or _digest(run) or len(set(run)) < 8:
        return False
    parts = SIGNS.split(run)
    if all(PART.fullmatch(p) for p in parts) or not any(c.isdigit() for c in run):
        if max(map(len, parts)) > STRETCH:
            parts = [p[i:i + STRETCH] for p in parts for i in range(0, len(p), STRETCH)]
        got, n = _parts_ratio("/".join(parts), enc, LEAST_PART)
        return n >= LEAST_PARTS and got < ratio
    tokens = sum(len(enc.encode_ordinary(run[i:i + STRETCH])) for i in range(0, len(run), STRETCH))
    return len(run) < ratio * tokens


def _random_stretches(run: str, enc, ratio: float) -> list[tuple[int, int]]:
    """The random parts of a run: the whole, or long parts, or the parts that a
    random stretch of it touches. UUIDs and digests are none."""
    if UUID.fullmatch(run) or _digest(run):
        return []
    # What is left out must not dilute or fill a stretch either.
    plain = UUID.sub(lambda m: "=" * len(m[0]), run)
    plain = HEXADECIMAL_PART.sub(lambda m: "=" * len(m[0]) if _digest(m[0]) else m[0], plain)
    if plain == run and _is_random(run, enc, ratio):
        return [(0, len(run))]
    parts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", plain)]
    found = [(a, b) for a, b in parts
             if b - a >= RANDOM_LENGTH and b - a < len(run) and _is_random(plain[a:b], enc, ratio)]
    last = len(plain) - WINDOW
    for at in sorted({*range(0, last + 1, STEP), last}) if last > 0 else ():
        piece = plain[at:at + WINDOW]
        if len(set(piece)) < 8:
            continue
        got, n = _parts_ratio(piece, enc)
        if n >= LEAST_PARTS and got < (WINDOW_RATIO if any(map(str.isdigit, piece)) else LETTERS_RATIO):
            # The parts that its middle touches, whole.
            lo, hi = at + STEP, at + WINDOW - STEP
            touched = [p for p in parts if p[0] < hi and p[1] > lo]
            if touched:
                found.append((touched[0][0], touched[-1][1]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_secrets(text: str | None, enc, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for a, b in runs:
        # Every long hexadecimal run lies in one of these.
        spans += [(a + m.start(), a + m.end(), "hex") for m in HEX.finditer(text[a:b])]
    if runs:
        base = sorted((s, e) for s, e, _ in spans)
        at = 0
        for a, b in runs:
            while at < len(base) and base[at][1] <= a:
                at += 1
            if any(s < b and e > a for s, e in base[at:at + 4]):
                continue
            spans += [(a + s, a + e, "random") for s, e in _random_stretches(text[a:b], enc, ratio)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_rows(vocabulary: str | None, ratio: float):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e}
                      for s, e, k in find_secrets(t.as_py(), enc, ratio)]
                     for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[1:]) + [pa.array(found, _SPANS)],
                                             batch.schema.names[1:] + ["secrets"])
    return run


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The ``keep`` columns and secrets: array of (kind, start, end)."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{text_col}`").alias("text"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    found = plain.mapInArrow(tidied(_scan_rows(vocabulary, ratio)), f"{schema}, "
                             "secrets array<struct<kind:string,start:long,end:long>>")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "secrets")


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _redact_rows(vocabulary: str | None, ratio: float, mark: str):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            texts = []
            for t in batch.column(0):
                t = t.as_py()
                spans = [{"start": s, "end": e} for s, e, _ in find_secrets(t, enc, ratio)]
                texts.append(redact(t, spans, mark))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]],
                                             batch.schema.names)
    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None,
                   ratio: float = RATIO, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    # By position: other columns may have any name.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ordered = plain.select(f"c{at}", *[c for c in plain.columns if c != f"c{at}"])
    return ordered.mapInArrow(tidied(_redact_rows(vocabulary, ratio, mark)), ordered.schema) \
        .select(*plain.columns).toDF(*names)
