import hashlib
import random
import re
import string

from shopflow.llm import secret_scan as S
from shopflow.llm.queries import QUERIES
from shopflow.llm.tokens import encoder

from .conftest import MEDIUM

ENC = encoder()


def _base(text):
    """Brute force of the base kinds: patterns as given, failing matches dropped."""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in
            spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_secret_scan"](spark, MEDIUM).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    seen = 0
    for r in rows:
        base = _base(docs[r["doc_id"]])
        seen += len(base)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(
            sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base
    assert seen > 10


def test_base_rules():
    kinds = lambda t: [(k, t[s:e]) for s, e, k in S.find_secrets(t, ENC)]
    assert kinds("API_KEY: 'abc.def'") == [("assign", "API_KEY: 'abc.def")]
    # A failing match takes its text with it.
    assert kinds("secret=token:abcdefgh") == []
    assert kinds("pa\u017fsword=abcdefgh to\u212aen=abcdefgh") == []
    assert kinds("AKIAAKIA" + "A" * 12) == [("access", "AKIAAKIA" + "A" * 12)]
    assert kinds("é" + "0" * 24) == [("hex", "0" * 24)]


def test_random_runs_and_exclusions():
    kinds = lambda t: [k for _, _, k in S.find_secrets(t, ENC)]
    assert kinds("key Zk3vQ9pXr7Lm2Tn8Wb5Yc1Hd see") == ["random"]
    assert kinds("id 123E4567-E89B-12D3-A456-426614174000 x") == []
    assert kinds("sum D41D8CD98F00B204E9800998ECF8427E x") == []
    assert kinds("name the_quick_brown_fox_42 and CamelCaseIdentifierName") == []
    assert kinds("number 12345678901234567890123") == []
    assert kinds("token = Zk3vQ9pXr7Lm2Tn8Wb5Yc1Hd") == ["assign"]


def test_readable_parts_do_not_dilute_a_random_string():
    rng = random.Random(11)
    mixed, letters = string.ascii_letters + string.digits, string.ascii_letters
    for before, after in (("", ""), ("com/company/service/internal/download/", ""),
                          ("company/service/internal/documents/download/session/", "/index/page")):
        for alphabet in (mixed, letters, string.ascii_uppercase):
            seen = 0
            for _ in range(200):
                key = "".join(rng.choices(alphabet, k=24))
                text = f"see {before}{key}{after} now"
                at = 4 + len(before)
                seen += any(s <= at and e >= at + 24 for s, e, k in S.find_secrets(text, ENC) if k == "random")
            assert seen >= 196, (before, alphabet, seen)


def test_letter_only_keys_and_readable_runs():
    kinds = lambda t: [k for _, _, k in S.find_secrets(t, ENC)]
    assert kinds("key EZZB-KRSN-KWRD-ISDX-TSBQ see") == ["random"]
    assert kinds("key qXvZkRwJpLmTgHsBnDcFyWqK7 see") == ["random"]
    for plain in ("THE_QUICK_BROWN_FOX", "getUserAccountSettingsById", "org/apache/spark/sql/catalyst",
                  "Rindfleischetikettierungsueberwachung", "anticonstitutionnellement",
                  "com/company/service/internal/download/session", "2024-01-01/2024-12-31",
                  "x86_64-unknown-linux-gnu", "api/v1/users/123e4567-e89b-12d3-a456-426614174000/settings",
                  "MAX_CONNECTION_TIMEOUT_SECONDS", "objects/D41D8CD98F00B204E9800998ECF8427E/file"):
        assert kinds(f"see {plain} now") == [], plain


def test_no_random_spans_in_plain_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").collect()]
    odd = [t[s:e] for t in texts for s, e, k in S.find_secrets(t, ENC) if k == "random"]
    assert all(any(c.isdigit() for c in x) for x in odd)


def test_redact_and_odd_rows(odd_docs, no_docs, odd_rows, spark):
    spans = [{"start": 2, "end": 5}, {"start": 4, "end": 6}, {"start": 8, "end": 9}]
    assert S.redact("0123456789", spans, "*") == "01*67*9"
    same = S.redact_secrets(odd_docs)
    assert same.columns == odd_docs.columns
    assert sorted(map(str, map(tuple, same.collect()))) == sorted(map(str, odd_rows))
    assert {len(r["secrets"]) for r in S.scan_secrets(odd_docs).collect()} == {0}
    assert S.scan_secrets(no_docs).collect() == [] and S.redact_secrets(no_docs).collect() == []
    masked = S.redact_secrets(spark.createDataFrame([(1, "a password=hunter2! b")], "doc_id int, text string"))
    assert masked.first()["text"] == "a [SECRET]! b"
