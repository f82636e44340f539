"""The thin queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, filter_audit, imatch, language_id, lexical_search, line_dedup, mixing, secrets, simhash, token_output, toxicity
from .common import shared_dir, table


#: The id that ends a document.
END_ID = 1


def tokenizer_file() -> str:
    """Where the tokenizer file of this installation is."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _crc(doc_id):
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared", "containment")


def _of_kind(kind: str):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update_ledger(docs, f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}")
    found = secrets.findings(docs, ledger)
    count = {f"n_{r.name}": _of_kind(r.name) for r in secrets.RULES}
    base = F.filter("found", lambda s: s["kind"].isin([r.name for r in secrets.RULES]))
    return found.select("doc_id", *(c.alias(k) for k, c in count.items()), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=False)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is read as a call to `reply` that the next assistant turn answers; later calls follow the first."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = messages.where("role = 'user'")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first"))
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    calls = asked.join(first, "conv_id").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.length("text").alias("chars"), F.when(F.col("turn") % 4 == 0, "first").alias("style"), F.col("turn"))).alias("arguments"),
        F.when(F.col("turn") > F.col("first"), F.array(name(F.col("first")))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = messages.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"))
    schemas = spark.createDataFrame([("reply", "chars", "integer", True), ("reply", "style", "string", True), ("reply", "turn", "integer", True)], "name string, field string, type string, required boolean")
    return chat.lines(messages, calls, results, schemas)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imatch.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        imatch.as_text(F.col("sigs")).alias("fingerprint"), imatch.as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        imatch.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), imatch.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), to, tokenizer_file(), END_ID)
    return token_output.read_tokens(spark, to)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = toxicity.sample(docs, table(spark, sf_dir, "labels"), lambda i: _crc(i) % 3 != 1)
    scored = toxicity.score(docs, toxicity.fit(learned))
    return scored.select("doc_id", F.coalesce(_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_crc("doc_id") % 4 != 2))
    named = language_id.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "lang")
    return filter_audit.audit(filter_audit.masks(failed, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_secret_scan, op3_line_dedup, op4_simhash, op5_chat_format, op6_imatch, op7_token_output, op8_toxicity, op9_mixing, op10_language_id,
        op11_lexical_search, op12_exact_dedup, op13_filter_audit,
    )
}


def _secret_sql() -> str:
    """Positions from the texts between the matches, summed up."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {i} AS ord, '{r.name}' AS kind, {r.min_chars} AS least, regexp_extract_all(t, {pattern}, 0) AS hits, regexp_extract_all(t, {pattern}, {r.group}) AS held, string_split_regex(t, {pattern}) AS gaps FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, ord, kind, least, hits, held, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT doc_id, ord, kind, hits[i] AS hit, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s FROM u WHERE length(held[i]) >= least),
f AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS b, count(*) FILTER (WHERE ord = 2) AS c,
      string_agg(kind || ':' || s::BIGINT || ':' || (s + length(hit))::BIGINT, ',' ORDER BY s, ord) AS spans FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN f USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM items WHERE len(w) > 0),
shingles AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM sized),
counted AS (SELECT item_id, count(*) AS n_shingles FROM shingles GROUP BY item_id),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
own AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
        FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_shingles AS containment
FROM own JOIN shingles USING (s) JOIN counted USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)""",
    "op5_chat_format": r"""
WITH m AS (SELECT *, 'call-' || turn AS id, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS first FROM conversations),
j AS (SELECT a.*, b.turn AS answered, c.turn AS asked FROM m a
      LEFT JOIN (SELECT conv_id, turn FROM m WHERE role = 'assistant') b ON a.role = 'user' AND b.conv_id = a.conv_id AND b.turn = a.turn + 1
      LEFT JOIN (SELECT conv_id, turn FROM m WHERE role = 'user') c ON a.role = 'assistant' AND c.conv_id = a.conv_id AND c.turn = a.turn - 1)
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN (turn > first)::INT ELSE -1 END AS depth,
  CASE WHEN role = 'user' THEN if(answered IS NULL, 'no_result', 'linked') WHEN role = 'assistant' THEN if(asked IS NULL, 'no_call', 'linked') ELSE 'plain' END AS status,
  CASE WHEN role = 'user' AND turn % 4 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_errors,
  '{"content":' || to_json(text)::VARCHAR || ',"conv_id":' || conv_id || ',"role":"' || role || '"'
  || CASE WHEN role = 'assistant' THEN ',"tool_call_id":"call-' || (turn - 1) || '"' ELSE '' END
  || CASE WHEN role = 'user' THEN ',"tool_calls":[{"arguments":{"chars":' || length(text) || if(turn % 4 = 0, ',"style":"first"', '') || ',"turn":' || turn || '},"depth":' || (turn > first)::INT
       || if(turn % 4 = 0, '', ',"errors":["missing style"]') || ',"id":"' || id || '","name":"reply","status":"' || if(answered IS NULL, 'no_result', 'linked') || '"}]' ELSE '' END
  || ',"turn":' || turn || '}' AS line
FROM j""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY item_id, term),
p AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
v AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * c.n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, c.n),
s AS (SELECT item_id, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * c.n) // c.l))))::BIGINT AS score FROM p JOIN q USING (term) JOIN v USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(k, b)),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
        sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
        sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r""",
    "op2_secret_scan": _secret_sql(),
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos) u),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE key IN (SELECT key FROM common)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id""",
}
