import math
import zlib

from shopflow.llm import toxicity as X
from shopflow.llm.queries import QUERIES

from .conftest import MEDIUM

PLAIN = X.Model({X.fold(k): w for k, w in X.PLAIN_LEXICON.items()})


def test_folding_finds_disguises():
    for text in ("you IDIOT", "you 1d10t", "an іdіоt", "ｉｄｉｏｔ", "an idiot!", "idіоts"):
        assert PLAIN.weigh(text)[1] == 1, text


def test_word_starts_and_exceptions():
    assert PLAIN.weigh("the vidiots and xmoron")[1] == 0
    assert PLAIN.weigh("put it in the trash can")[1] == 0
    assert PLAIN.weigh("trash, and a trash can")[1] == 1
    assert PLAIN.weigh("trash candy")[1] == 1


def test_matches_equal_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    for r in docs.limit(300).collect():
        folded = X.fold(r["text"])
        safe = [X.fold(e) for e in model.exceptions]
        n = 0
        for i, c in enumerate(folded):
            if c.isalnum() and (i == 0 or not folded[i - 1].isalnum()):
                harmless = any(folded.startswith(e, i) and not folded[i + len(e):i + len(e) + 1].isalnum()
                               for e in safe)
                n += not harmless and any(folded.startswith(e, i) for e in model.lexicon)
        assert model.weigh(r["text"])[1] == n


def test_longer_texts_score_lower():
    short, long = PLAIN.weigh("idiot " + "word " * 20), PLAIN.weigh("idiot " + "word " * 2000)
    assert PLAIN.score(short[0], short[2]) > PLAIN.score(long[0], long[2])


def test_query_held_out(spark):
    rows = QUERIES["op5_toxicity"](spark, MEDIUM).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == 1000
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows
            if r["held_out"] and r["doc_id"] in truth]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(t for _, t in held) > 3


def test_lexicon_takes_the_beginning_that_says_it_best():
    stems = {"sto": (45, 2.0), "stoi": (40, 8.0), "stoit": (40, 8.0), "stoita": (20, 9.0),
             "gra": (30, 4.0), "grab": (15, 4.0), "gram": (15, 4.0)}
    assert X.choose_lexicon(stems) == {"stoit": X.MOST_WEIGHT, "gra": 4.0}


def test_copies_of_one_text_do_not_make_entries(spark):
    toxic = [(i, "blurb frobnication of the whole gribble text") for i in range(60)]
    toxic += [(100 + i, f"word{i} you grampus{i % 5} thing{i}") for i in range(60)]
    clean = [(1000 + i, f"word{i} you fine thing{i} of text") for i in range(600)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    model = X.fit(docs, docs.selectExpr("doc_id", "int(doc_id < 1000) as toxic"))
    assert "grampus" in {e[:7] for e in model.lexicon}
    assert not any("frobnication".startswith(e) for e in model.lexicon)


def test_a_hot_group_of_copies_does_not_hide_a_word(spark):
    toxic = [(i, "thing0 you grampus of word0") for i in range(1000)]
    toxic += [(2000 + i, f"word{i} you grampus{i % 5} thing{i}") for i in range(100)]
    clean = [(5000 + i, f"word{i} you fine thing{i} of text") for i in range(600)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    model = X.fit(docs, docs.selectExpr("doc_id", "int(doc_id < 5000) as toxic"))
    assert any("grampus".startswith(e) for e in model.lexicon)
    assert model.weigh("a grampus3 there")[1] == 1


def test_harmless_words_are_learned(spark):
    """A word that begins like a lexicon entry but stands in other rows."""
    clean = [(i, f"the grammar of word{i} is fine" if i % 3 else f"word{i} is here") for i in range(400)]
    toxic = [(1000 + i, f"word{i} grampus{i % 7} thing{i}") for i in range(100)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id >= 1000) as toxic")
    model = X.fit(docs, labels)
    assert any("grampus".startswith(e) for e in model.lexicon)
    assert model.weigh("the grammar")[1] == 0 and model.weigh("a grampus3")[1] == 1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (9, 1, None), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for model in (X.fit(odd_docs, labels), X.fit(no_docs, labels), X.fit(odd_docs, labels.where("false"))):
        rows = X.toxicity_scores(odd_docs, model)
        assert rows.count() == 10 and rows.columns.count("toxic_score") == 1
        assert all(0 <= r["toxic_score"] <= 1 for r in rows.collect())
        assert X.toxicity_scores(no_docs, model).collect() == []


def test_blanks_do_not_dilute_a_score():
    for blanks in (" " * 500, "\n" * 300, "\t \n" * 200):
        for text in ("you idiot" + blanks, blanks + "you" + blanks + "idiot"):
            assert PLAIN.weigh(text) == PLAIN.weigh("you idiot")
    assert PLAIN.weigh("you\tidiot here")[2] == 3 and PLAIN.weigh("  \n ")[2] == 0


def test_exceptions_of_any_length_and_number():
    long = "idiot" + "ically" * 20
    model = X.Model(dict(PLAIN.lexicon), exceptions=(long, "idiot box", *(f"{c} b" for c in "cdefghijkl")))
    assert model.weigh(f"an {long} word")[1] == 0
    assert model.weigh("an idiot box " + "c b d b e b f b g b h b i b j b k b l b")[1] == 0
    assert model.weigh("an idiot bo")[1] == 1


def _weighed(model, text):
    """Summed weights, matches and words by looking at every place of the text."""
    folded, safe = X.fold(text), [X.fold(e) for e in model.exceptions]
    at = [i for i, c in enumerate(folded) if i == 0 or not folded[i - 1].isalnum()]
    spans = [(i, i + len(e)) for i in at for e in safe
             if folded.startswith(e, i) and not folded[i + len(e):i + len(e) + 1].isalnum()]
    best = {}
    for i in at:
        for entry, weight in model.lexicon.items():
            end = i + len(entry)
            if folded.startswith(entry, i) and not any(a <= i and b >= end for a, b in spans):
                best[i] = max(weight, best.get(i, 0.0))
    return sum(best.values()), len(best), len(folded.split())


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(150)
    model = X.fit(spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    scored = {r["doc_id"]: r["toxic_score"] for r in X.toxicity_scores(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        weight, matches, words = _weighed(model, r["text"])
        got = model.weigh(r["text"])
        assert abs(got[0] - weight) < 1e-9 and got[1:] == (matches, words)
        x = model.intercept + model.slope * math.log1p(100.0 * weight / (words + 10.0))
        assert abs(scored[r["doc_id"]] - 1 / (1 + math.exp(-x))) < 1e-6
