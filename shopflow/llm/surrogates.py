"""Surrogate generation: personal data gets keyed replacements of its own kind.

Detected kinds: ``email``, ``phone``, ``card``, ``ip`` (IPv4 and IPv6), ``ssn`` and ``name``
(after a title that tells the gender). A value is reduced to its normal form
(digits, lower case, title cut off); the keyed surrogate of the normal form is
poured back into the occurrence's own format: separators, brackets, letter case
and the country code stay, a card keeps its first digit and whether its check
digit is right, an address keeps its network class, a name its script, its
gender and its number of words.

Numbers, addresses and mail names are permuted within the set of values of their
format by a keyed Feistel network, so different values of one format differ.
Names are built from syllables, where two may meet. A check over all distinct
values of the corpus finds surrogates that meet each other or a real value; the
first keeps its surrogate and the others draw again, until all are distinct. One
value has one surrogate everywhere, so references stay references. A name found after
a title is one person in its document: titles of that name agree on the gender (the first
that tells it), and the name, or its last word alone, is replaced without a title too.

A format may have too few values: one only (``_@-.com``), or all in use by the corpus.
After every ``ROUNDS`` attempts the surrogate is drawn from a wider space, marked as
such: a longer mail name, an extension ``x123456`` behind digits, a private IPv6 address
for IPv4, more syllables. Every widening multiplies the space by 4,000 at least, so it
outgrows any table and the redrawing ends.

Defined results: null texts stay null, texts without personal data stay as they
are, repeated rows are treated alike, other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.store import Store, bounded_batches, tidied

KEY = b"surrogates"
#: Redrawn values (about so many bytes) are broadcast at most, else joined.
BROADCAST_BYTES = 8 << 20
#: Attempts after which a surrogate is drawn from a wider space.
ROUNDS = 3

# Titles and the gender that each tells.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Don": "m", "Signor": "m", "господин": "m", "г-н": "m", "κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f",
    "Mlle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f", "Signora": "f",
    "госпожа": "f", "г-жа": "f", "κυρία": "f",
    "Dr": "n", "Prof": "n",
}
# Syllables per script, and endings of given names per gender.
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδκλμνπρστ" for v in "αειο"],
}
ENDINGS = {
    "latin": {"m": ("n", "r", "s"), "f": ("na", "ra", "la"), "n": ("l", "m", "t")},
    "cyrillic": {"m": ("н", "р", "й"), "f": ("на", "ра", "я"), "n": ("л", "м", "т")},
    "greek": {"m": ("ος", "ης", "ας"), "f": ("να", "ρα", "λη"), "n": ("ν", "λ", "μ")},
}

# Country calling codes, those of one and two digits listed.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d{2})"
_COUNTRY = re.compile(r"\+" + _CODE)
_WORD = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][\w'’-]+"
PATTERNS = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\w:]))"
    r"|(?P<card>(?<![\w.-])(?:[3-6]\d{3}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)"
    r"(?=(?:[ -]?\d{4}){3}(?!\d)))"
    r"(?:(?P<sep>[ -]?)\d{4})(?:(?P=sep)\d{4})(?:(?P=sep)\d{1,4})(?![\w]|-\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}"
    # International: ten digits after +1, nine after +33 and +34, else six to twelve.
    r"|\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
    r"|\+3[34](?:[ .-]?\(0\))?(?:[ .-]?\d){9}"
    r"|\+(?!1|3[34])" + _CODE + r"(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d){6,12}"
    # National: North American without signs; after a 0 in pairs, two groups or none.
    r"|(?<!\d[.,-])(?:[2-9]\d{2}[2-9]\d{6}|0[1-9](?:(?P<pair>[ .-])\d{2})(?:(?P=pair)\d{2}){3}"
    r"|0[1-9]\d{1,3}[ /-]\d{5,8}|0[1-9]\d{8,9})(?![.,]\d))(?![\w]))"
    r"|(?P<name>\b(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
    + r")\b\.?[ ](?P<who>" + _WORD + r"(?:[ ]" + _WORD + r")?))")
_DIGIT = re.compile(r"\d")
_TITLED = ahocorasick.Automaton()
for _title in TITLES:
    for _end in (" ", ". "):
        _TITLED.add_word(_title + _end, True)
_TITLED.make_automaton()
KINDS = ("email", "ip", "card", "ssn", "phone", "name")


# --------------------------------------------------------------- permuting --

def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): six Feistel rounds on an even number of
    bits, walked until the value is in range."""
    if n <= 1:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    size = (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            h = hashlib.blake2b(right.to_bytes(size, "big"), key=key[:64], digest_size=min(64, size + 8),
                                person=bytes([r]) + hashlib.blake2b(
                                    tweak.encode(), digest_size=15).digest())
            left, right = right, left ^ (int.from_bytes(h.digest(), "big") & mask)
        x = (left << half) | right
        if x < n:
            return x


def _digits(digits: str, key: bytes, tweak: str) -> str:
    """A permutation of the strings of as many digits that do not start with 0 or
    1 (of all strings if this one does)."""
    if digits[:1] >= "2":
        n = 8 * 10 ** (len(digits) - 1)
        return str(permute(int(digits) - 2 * 10 ** (len(digits) - 1), n, key, tweak)
                   + 2 * 10 ** (len(digits) - 1))
    # Those that start with 0 or 1 are permuted among themselves.
    n = 2 * 10 ** (len(digits) - 1)
    return str(permute(int(digits), n, key, tweak)).zfill(len(digits))


def _national(digits: str, key: bytes, tweak: str) -> str:
    """A phone number without a country code, within the numbers that are found."""
    n = len(digits)
    if digits[0] == "0" and n > 2 and digits[1] != "0":
        low = 10 ** (n - 2)
        return "0" + str(permute(int(digits) - low, 9 * low, key, f"{tweak}0{n}") + low)
    if n == 10 and digits[0] >= "2" and digits[3] >= "2":
        area, rest = int(digits[:3]) - 200, int(digits[3:]) - 2_000_000
        area, rest = divmod(permute(area * 8_000_000 + rest, 6_400_000_000, key, tweak + "10"), 8_000_000)
        return f"{area + 200}{rest + 2_000_000}"
    return _digits(digits, key, tweak)


def _check_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _label(label: str, key: bytes, tweak: str) -> str:
    """Permutes a label within its pattern of letters, digits and signs."""
    x, n = 0, 1
    for c in label:
        base = 10 if c.isdigit() else 26 if "a" <= c <= "z" else 1
        value = int(c) if c.isdigit() else ord(c) - 97 if base == 26 else 0
        x, n = x * base + value, n * base
    shape = "".join("0" if c.isdigit() else "a" if "a" <= c <= "z" else c for c in label)
    x = permute(x, n, key, tweak + shape)
    out = []
    for c in reversed(label):
        base = 10 if c.isdigit() else 26 if "a" <= c <= "z" else 1
        x, value = divmod(x, base)
        out.append(str(value) if c.isdigit() else chr(97 + value) if base == 26 else c)
    return "".join(reversed(out))


def _address(ip: str, key: bytes, tweak: str) -> str:
    x = int.from_bytes(bytes(int(p) for p in ip.split(".")), "big")
    # Networks that keep to themselves, as (first address, bits).
    for first, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16),
                        (127 << 24, 24), (224 << 24, 29), (0, 24)):
        if first <= x < first + (1 << bits):
            y = first + permute(x - first, 1 << bits, key, f"{tweak}{first}")
            break
    else:
        y = x
        while True:
            y = permute(y, 1 << 32, key, tweak)
            if not (y >> 24 in (0, 10, 127) or y >> 29 == 7 or y >> 20 == 172 << 4 | 1
                    or y >> 16 == 192 << 8 | 168):
                break
    return ".".join(str(b) for b in y.to_bytes(4, "big"))


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name(words: str, gender: str, key: bytes, attempt: int) -> str:
    out = []
    parts = words.split(" ")
    for i, w in enumerate(parts):
        script = _script(w)
        given = i == 0 and len(parts) > 1
        h = int.from_bytes(hashlib.blake2b(f"{w}|{attempt}|{gender if given else ''}".encode(),
                                           key=key[:64], digest_size=16).digest(), "big")
        made = ""
        for _ in range(3 + 2 * (attempt // ROUNDS)):
            h, s = divmod(h, len(SYLLABLES[script]))
            made += SYLLABLES[script][s]
        if given:
            ends = ENDINGS[script][gender]
            made += ends[h % len(ends)]
        out.append(made)
    return " ".join(out)


# --------------------------------------------------------------- occurrences --

def normal(kind: str, found: str, gender: str = "") -> str:
    """The normal form that decides whether two occurrences are one value."""
    if kind == "email":
        return found.lower()
    if kind == "name":
        return f"{gender}:{found.lower()}"
    if kind == "ip":
        if ":" in found:
            return str(ipaddress.IPv6Address(found))
        return ".".join(str(int(p)) for p in found.split("."))
    if kind == "phone" and found.startswith("+"):
        # The code as set off, if it is; else by the list.
        code = (re.match(r"\+(\d{1,3})(?!\d)", found) or _COUNTRY.match(found) or
                re.match(r"\+(\d)", found)).group().removeprefix("+")
        return f"+{code}:" + re.sub(r"\D", "", found[len(code) + 1:])
    return re.sub(r"\D", "", found)


def _drawn_number(value: str, attempt: int, key: bytes, n: int) -> int:
    h = hashlib.blake2b(f"{value}|{attempt}".encode(), key=key[:64], digest_size=64).digest()
    return int.from_bytes(h, "big") % n


def _widened(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The surrogate's normal form in a space wider than the value's format."""
    wider = attempt // ROUNDS
    if kind == "email":
        local, domain = value.split("@")
        x, more = _drawn_number(value, attempt, key, 26 ** (6 * wider)), ""
        for _ in range(6 * wider):
            x, letter = divmod(x, 26)
            more += chr(97 + letter)
        return f"{local[:1] if local[:1].isalpha() else 'x'}{more}@{domain}"
    if kind == "ip":
        return str(ipaddress.IPv6Address(0xFD << 120 | _drawn_number(value, attempt, key, 1 << 120)))
    return f"{surrogate(kind, value, 0, key)}x{_drawn_number(value, attempt, key, 10 ** (6 * wider)):0{6 * wider}}"


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The normal form of the surrogate of a normal form."""
    if attempt >= ROUNDS and kind != "name":
        return _widened(kind, value, attempt, key)
    tweak = f"{kind}{attempt}"
    if kind == "email":
        local, domain = value.split("@")
        host, _, top = domain.rpartition(".")
        return f"{_label(local, key, tweak)}@{_label(host, key, 'host' + str(attempt))}.{top}"
    if kind == "ip" and ":" in value:
        # The first group tells the kind of network and stays.
        first, rest = divmod(int(ipaddress.IPv6Address(value)), 1 << 112)
        return str(ipaddress.IPv6Address(first << 112 | permute(rest, 1 << 112, key, f"{tweak}:{first}")))
    if kind == "ip":
        return _address(value, key, tweak)
    if kind == "card":
        body = value[1:-1]
        if value[0] == "2":   # 2221 to 2720
            low = 221 * 10 ** (len(body) - 3)
            new = "2" + str(permute(int(body) - low, 500 * 10 ** (len(body) - 3), key, tweak + "2") + low)
            off = int(value[-1]) - _check_digit(value[:-1])
            return new + str((_check_digit(new) + off) % 10)
        new = value[0] + str(permute(int(body), 10 ** len(body), key, tweak + value[0])
                             ).zfill(len(body))
        off = int(value[-1]) - _check_digit(value[:-1])
        return new + str((_check_digit(new) + off) % 10)
    if kind == "name":
        gender, words = value.split(":", 1)
        return f"{gender}:{_name(words, gender, key, attempt)}"
    if kind == "phone" and value.startswith("+"):
        code, digits = value.split(":")
        return f"{code}:{_digits(digits, key, tweak + code)}"
    if kind == "phone":
        return _national(value, key, tweak)
    return _digits(value, key, tweak)


def poured(kind: str, found: str, new: str) -> str:
    """The surrogate's normal form in the format of an occurrence."""
    if kind == "email" and len(found) != len(new):      # widened
        return new
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for o, c in zip(found, new, strict=True))
    if kind == "ip":
        return new.upper() if any(map(str.isupper, found)) else new
    if kind == "name":
        out, words = [], found.split(" ")
        # The last word alone stands for the whole name.
        for old, w in zip(words, new.split(":", 1)[1].split(" ")[-len(words):], strict=True):
            out.append(w.upper() if old.isupper() and len(old) > 1 else w[0].upper() + w[1:])
        return " ".join(out)
    head = 0
    if kind == "phone" and found.startswith("+"):
        code, new = new.split(":")
        head = len(code)
    new, mark, extension = new.partition("x")
    digits = iter(new)
    return found[:head] + "".join(next(digits) if c.isdigit() else c for c in found[head:]) + mark + extension


def may_hold_entities(text: str) -> bool:
    """False only for texts without a digit, an @ and a title: no pattern can match."""
    return ("@" in text or _DIGIT.search(text) is not None
            or next(_TITLED.iter(text), None) is not None)


def _is_address(found: str) -> bool:
    """Whether this is an IPv6 address, and no two words joined by colons."""
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return len([g for g in found.split(":") if g]) > 2 or re.match(
        r"[23][0-9a-f]{3}:|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:", found.lower()) is not None


def entities(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, as found, normal form) from left to right. The normal form
    of a name's last word alone is that of the name, with ``#`` behind it."""
    if not may_hold_entities(text):
        return
    found, genders = [], {}
    for m in PATTERNS.finditer(text):
        kind = "ip" if m.group("ip6") else next(k for k in KINDS if m.group(k))
        if m.group("ip6") and not _is_address(m.group()):
            continue
        if kind == "name":
            who, gender = m.group("who"), TITLES[m.group().split(" ", 1)[0].rstrip(".")]
            found.append((*m.span("who"), kind, who, ""))
            if genders.get(who.lower(), "n") == "n":
                genders[who.lower()] = gender
        else:
            found.append((*m.span(), kind, m.group(), normal(kind, m.group())))
    if genders:
        found = sorted([*found, *_untitled(text, found)])
    for start, end, kind, shown, value in found:
        if kind == "name":
            whole = value or shown
            value = normal(kind, whole, genders[whole.lower()]) + ("#" if value not in ("", shown) else "")
        yield start, end, kind, shown, value


def _untitled(text: str, found: list) -> Iterator[tuple[int, int, str, str, str]]:
    """Names of the document, and their last words, where they stand without a title."""
    names = ahocorasick.Automaton()
    for _, _, kind, who, _ in found:
        if kind == "name":
            for short in (who, who.rsplit(" ", 1)[-1]):
                if short not in names:           # of two persons of one last name, the first
                    names.add_word(short, (short, who))
    names.make_automaton()
    taken, at = [(start, end) for start, end, *_ in found], 0
    inside = lambda c: c.isalnum() or c in "_'’-"
    for last, (short, who) in names.iter_long(text):
        start, end = last - len(short) + 1, last + 1
        if inside(text[start - 1:start] or " ") or inside(text[end:end + 1] or " "):
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or end <= taken[at][0]:
            yield start, end, "name", short, who


def replace(text: str, redrawn: dict[tuple[str, str], str], key: bytes = KEY) -> tuple[str, list]:
    """(text with surrogates, spans of them as (kind, start, end))."""
    out, at, size, spans = [], 0, 0, []
    for start, end, kind, found, value in entities(text):
        whole = value.removesuffix("#")
        new = poured(kind, found, redrawn.get((kind, whole)) or surrogate(kind, whole, 0, key))
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = end
    return "".join(out) + text[at:] if out else text, spans


# --------------------------------------------------------------------- Spark --

def _distinct_rows(batches):
    for batch in batches:
        seen = sorted({(e[2], e[4].removesuffix("#")) for t in batch.column(0) for e in entities(t.as_py() or "")})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string())],
            ["kind", "value"])


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(
                    [surrogate(*x, key) for x in zip(kinds, values, attempts, strict=True)],
                    pa.string())], ["kind", "value", "attempt", "surrogate"])
    return run


def redrawn_values(store: Store, docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of the values whose first surrogate met another's or
    a real value; distinct from all others."""
    schema = "kind string, value string, attempt int, surrogate string"
    values = docs.select("text").mapInArrow(tidied(_distinct_rows), "kind string, value string").distinct()
    table = store.save(values.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), schema), "drawn")
    while True:
        real = table.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        # Of those that meet, the earliest attempt and smallest value stays.
        first = table.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "value")).alias("stays"))
        judged = table.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left") \
            .withColumn("again", F.col("real").isNotNull()
                        | (F.struct("attempt", "value") != F.col("stays")))
        if not judged.where("again").limit(1).count():
            return table.where("attempt > 0").select("kind", "value", "surrogate")
        table = store.save(judged.select(
            "kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
            .mapInArrow(_drawn(key), schema), "redrawn")


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _replace_rows(key: bytes, shared: dict | None):
    def run(batches):
        for batch in batches:
            own = batch.column(1).to_pylist()
            texts, spans = [], []
            for t, mine in zip(batch.column(0), own, strict=True):
                t = t.as_py()
                redrawn = shared if shared is not None else {
                    (x["kind"], x["value"]): x["surrogate"] for x in mine or ()}
                new, found = replace(t, redrawn, key) if t else (t, [])
                texts.append(new)
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                list(batch.columns[2:]) + [pa.array(texts, pa.string()), pa.array(spans, _SPAN)],
                batch.schema.names[2:] + ["new_text", "spans"])
    return run


def with_surrogates(docs: DataFrame, text_col: str = "text", key: bytes = KEY,
                    spans_col: str = "surrogates") -> DataFrame:
    """``docs`` with the text replaced, and the spans of surrogates in it."""
    store = Store(docs.sparkSession, "surrogates")
    bounded_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.select(F.col(f"`{text_col}`").alias("text"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)
                          if c != text_col])
    redrawn = store.save(redrawn_values(store, plain, key), "final")
    size = redrawn.agg(F.sum(F.length("value") + F.length("surrogate") + 64).alias("b")).first()["b"] or 0
    kept = [c for c in plain.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields
                       if f.name != "text")
    none = F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>").alias("own")
    if size <= BROADCAST_BYTES:
        shared = {(r["kind"], r["value"]): r["surrogate"] for r in redrawn.collect()}
        ready = plain.select("text", none, *kept)
    else:
        # Too many to hold in every task: each text gets those it needs.
        shared = None
        keyed = plain.withColumn("text_key", F.sha2("text", 256))
        needed = keyed.where("text is not null").select("text", "text_key").mapInArrow(
            _needed_rows, "text_key string, kind string, value string").distinct() \
            .join(redrawn, ["kind", "value"]).groupBy("text_key").agg(
            F.collect_list(F.struct("kind", "value", "surrogate")).alias("own"))
        ready = keyed.join(needed, "text_key", "left").select("text", "own", *kept)
    done = ready.mapInArrow(tidied(_replace_rows(key, shared)), (schema + ", " if schema else "")
                            + "new_text string, spans array<struct<kind:string,start:long,end:long>>")
    return done.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"c{i}").alias(c)
                         for i, c in enumerate(names) if c != spans_col],
                       F.col("spans").alias(spans_col))


def _needed_rows(batches):
    for batch in batches:
        rows = [(k.as_py(), e[2], e[4].removesuffix("#")) for t, k in zip(batch.column(0), batch.column(1), strict=True)
                for e in entities(t.as_py())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(3)],
            ["text_key", "kind", "value"])
