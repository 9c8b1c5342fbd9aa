"""The registered queries of this subpackage: ``QUERIES`` and, where SQL can say
the same, ``ORACLE`` (DuckDB). Each applies its operator with production
parameters to its whole table and derives the digest columns from its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import chat, filter_audit, language, merkle, toxicity
from shopflow.llm.decontaminate import contamination
from shopflow.llm.exact_dedup import exact_duplicates
from shopflow.llm.fingerprints import as_text, likeness, order_minhash, with_next
from shopflow.llm.fitting import remainder
from shopflow.llm.ngram_join import ngram_components
from shopflow.llm.packing import pack
from shopflow.llm.secret_scan import scan_secrets
from shopflow.llm.sharding import LAW, shard_rows
from shopflow.llm.store import Store
from shopflow.llm.surrogates import with_surrogates
from shopflow.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


# ------------------------------------------------------------------ 1 to 5 --

@query("op1_sharding")
def op1(spark, sf_dir):
    shards = shard_rows(read_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op2_decontamination")
def op2(spark, sf_dir):
    found = contamination(read_table(spark, sf_dir, "documents"),
                          read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "overlap", "matched")


@query("op3_pii_surrogates")
def op3(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs).select("doc_id", "text", "surrogates")


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), language.HOLD_OUT) == 2, F.lit(False))
        .alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), toxicity.HOLD_OUT) == 0, F.lit(False))
        .alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_matches")


# ----------------------------------------------------------------------- 6 --

NGRAM_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN w ELSE w[i:i + {k} - 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS i
        FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
meet AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM meet JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE {den} * o >= {num} * (x.n + y.n - o)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT reach.doc_id, coalesce(max(sizes.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


@query("op6_ngram_jaccard_join", NGRAM_SQL.format(k=4, num=85, den=100))
def op6(spark, sf_dir):
    return ngram_components(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


# ----------------------------------------------------------------- 7 and 8 --

def _count(kind: str):
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_secret_scan")
def op7(spark, sf_dir):
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", _count("assign"), _count("access"), _count("hex"),
                        F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("secrets")).alias("spans"))


@query("op8_packing")
def op8(spark, sf_dir):
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


# ----------------------------------------------------------------------- 9 --

PROBE = "</s>[INST] ok [/INST]"

# The template's escapes, as chains of replacements: references first.
_ESCAPED = "text"
for _old, _new in (("&amp;", "&amp;amp;"), ("&lt;", "&amp;lt;"), ("&#91;", "&amp;#91;"),
                   ("&#10;", "&amp;#10;"), ("<<SYS>>", "&lt;<SYS>>"), ("<</SYS>>", "&lt;</SYS>>"),
                   ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"),
                   ("[/INST]", "&#91;/INST]")):
    _ESCAPED = f"replace({_ESCAPED}, '{_old}', '{_new}')"

CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(3 + length(role) + 1 + length({_ESCAPED}) + 4)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


#: Layouts dealt by the conversation's id; records above so many bytes stay rows.
DEALT, RECORD_BYTES = 4, 4 << 20


def _told(talks):
    """The turns of conversations that arrive in several layouts: by its id, one
    stays a table of turn rows or becomes a JSON record with a list of messages, a
    list in other words (from, value), or, where it is one question and its answer, a
    prompt or an instruction. Every record is read by the mapping its own fingerprint selects."""
    columns = ["conv_id", "turn", "role", "text"]
    deal = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % DEALT, F.lit(DEALT - 1))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    dealt = talks.select(*columns, deal.alias("deal"))
    whole = dealt.where(F.col("deal") < DEALT - 1).groupBy("conv_id", "deal").agg(
        F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text"))))
        .alias("t"), F.sum(F.octet_length(text("text")) + F.octet_length(text("role")) + 32).alias("bytes"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    pair = (F.size("t") == 2) & (first["role"] == "user") & (second["role"] == chat.ASSISTANT)
    said = {"user": "human", chat.ASSISTANT: "gpt"}
    other = lambda role: F.coalesce(*[F.when(role == a, b) for a, b in said.items()], role)
    reversible = ~F.exists("t", lambda x: x["role"].isin(*chat.SPOKEN))
    record = F.when(pair & (F.col("deal") == 0), F.to_json(F.struct(
        first["text"].alias("prompt"), second["text"].alias("completion")))) \
        .when(pair & (F.col("deal") == 1), F.to_json(F.struct(
            first["text"].alias("instruction"), second["text"].alias("output")))) \
        .when((F.col("deal") == 1) & reversible, F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            other(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))) \
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    fits = F.col("bytes") <= RECORD_BYTES
    records = whole.where(fits).select("conv_id", record.alias("record"))
    told = chat.record_turns(records, "record").select(
        F.col("conv_id").alias("key"), F.posexplode("turns").alias("turn", "t")).select(
        "key", F.col("turn").cast(talks.schema["turn"].dataType).alias("turn"), "t.role", "t.text")
    rows = dealt.where(F.col("deal") == DEALT - 1).select(*columns).unionByName(
        whole.where(~fits).select("conv_id", F.inline("t")))
    return chat.turn_rows(rows, columns).unionByName(told)


@query("op9_chat_format", CHAT_SQL)
def op9(spark, sf_dir):
    columns = ["conv_id", "turn", "role", "text"]
    talks = read_table(spark, sf_dir, "conversations").select(*columns)
    probe = spark.range(1).select(
        F.lit(-1).cast(talks.schema["conv_id"].dataType).alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(PROBE).alias("text"))
    turns = _told(talks.unionByName(probe))
    # Written, and everything below read back from what was written.
    written = Store(spark, "chat").save(chat.format_turns(turns), "formatted")
    back = chat.read_back(written)
    loss = F.array_join("loss_texts", "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(told, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


# ---------------------------------------------------------------------- 10 --

@query("op10_order_minhash")
def op10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pairs = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = pairs.withColumn("edited", F.concat(
        F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.col("next_text").substr(F.lit(1), half)))
    printed = edited.withColumn("edited_print", order_minhash(F.col("edited")))
    return printed.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))


# ---------------------------------------------------------------------- 11 --

DEDUP_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN groups USING (t)
"""


@query("op11_exact_dedup", DEDUP_SQL)
def op11(spark, sf_dir):
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------------- 12 --

AUDIT_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
          FROM labels GROUP BY doc_id),
split AS (
  SELECT texts.*, doc_id > least AS copy, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals
  FROM texts JOIN firsts USING (t)),
masked AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * capitals > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copy::INT AS mask
  FROM split),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
walks(filter_order, before, active, letter, step) AS (
  SELECT '', 0, 0, '', 0
  UNION ALL
  SELECT filter_order || l.letter, active, active | bit, l.letter, step + 1
  FROM walks JOIN letters l ON active & bit = 0),
steps AS (
  SELECT o.filter_order, w.step, w.before, w.active, w.active - w.before AS bit
  FROM walks o JOIN walks w ON o.step = 5 AND w.step > 0 AND starts_with(o.filter_order, w.filter_order)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & active = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps CROSS JOIN cells GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark, sf_dir):
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------------- 13 --

def _leaf_sql(text: str) -> str:
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Bitwise CRC-32 of a decimal id (reflected polynomial 0xEDB88320).
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))))"""

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
         CASE WHEN {CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql('text')} END AS given
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf, given) - 1 AS idx FROM leaves),
sources(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)),
         any_value((n + 2) // 3) FROM sources WHERE n > 1 GROUP BY tree, idx // 3),
subroots AS (SELECT tree, level, hash, row_number() OVER (ORDER BY tree) - 1 AS idx FROM sources WHERE n = 1),
top(tree, level, idx, hash, n) AS (
  SELECT 'top', 0, idx, hash, count(*) OVER () FROM subroots
  UNION ALL
  SELECT 'top', any_value(level) + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)),
         any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY idx // 3),
nodes AS (SELECT * FROM sources WHERE n > 1 UNION ALL SELECT * FROM top WHERE n > 1),
links AS (
  SELECT a.tree, a.level, a.idx,
         coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  GROUP BY a.tree, a.level, a.idx),
climb(doc_id, leaf, home, folded, proof, tree, level, idx) AS (
  SELECT doc_id, leaf, tree, given, '', tree, 0, idx FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.home,
         CASE WHEN k.tree IS NULL THEN c.folded ELSE sha256(k.l || c.folded || k.r) END,
         CASE WHEN k.tree IS NULL THEN c.proof ELSE c.proof || k.l || k.r END,
         CASE WHEN k.tree IS NULL THEN 'top' ELSE c.tree END,
         CASE WHEN k.tree IS NULL THEN 0 ELSE c.level + 1 END,
         CASE WHEN k.tree IS NULL THEN s.idx ELSE c.idx // 3 END
  FROM climb c LEFT JOIN links k ON k.tree = c.tree AND k.level = c.level AND k.idx = c.idx
  LEFT JOIN subroots s ON s.tree = c.tree
  WHERE k.tree IS NOT NULL OR c.tree <> 'top'),
root AS (SELECT hash, level FROM top WHERE n = 1)
SELECT c.doc_id, c.leaf, s.hash AS subroot, root.hash AS root, sha256(c.proof) AS proof_sha256,
       c.folded AS folded_root, c.folded = root.hash AS verified
FROM climb c JOIN subroots s ON s.tree = c.home JOIN root ON c.tree = 'top' AND c.level = root.level
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(read_table(spark, sf_dir, "documents"), tampered={
        "text": F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
