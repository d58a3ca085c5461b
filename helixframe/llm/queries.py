"""Registered queries of the training-data operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, conversation_repair, decontaminate, exact_dedup, langid, licenses, line_dedup, packing, periodic_runs, quality, simhash, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; digests of the ids."""
    pieces = packing.tokenize_pieces(_table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit_pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base phrases, labels of phrases and template spans, and the highest share covered."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    starts, base = F.transform("phrases", lambda p: p["start"]), F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    own = F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))).alias("score"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of its equals."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words in windows of benchmark items; digest of the items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT item_id, least(len(ws), 13) AS m, unnest(range(0, greatest(len(ws) - 12, 1))) AS s, ws FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, m, list_slice(ws, s + 1, s + m) AS win FROM bw),
dp AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS s FROM d),
h AS (
  SELECT p.doc_id, p.s, w.m, w.item_id
  FROM (SELECT doc_id, s, m, list_slice(ws, s + 1, s + m) AS win, len(ws) AS n FROM dp CROSS JOIN (SELECT DISTINCT m FROM w)) p
  JOIN w ON p.m = w.m AND p.win = w.win WHERE p.s + p.m <= p.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS x FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words in windows of earlier documents; digest of the words that stay."""
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, s, list_slice(ws, s + 1, s + 13) AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 12)) AS s FROM d WHERE len(ws) >= 13)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS x FROM f),
k AS (
  SELECT p.doc_id, string_agg(p.w, ' ' ORDER BY p.x) AS kept
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS x FROM d) p
  LEFT JOIN r ON r.doc_id = p.doc_id AND r.x = p.x WHERE r.x IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest id that links reach."""
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from those not held out, with the model's own rejection."""
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("in_held_out").alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.rejected").alias("rejected"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as compressed archives, read back by type: responses with their payloads against the digests, revisits by their headers."""
    warc.register(spark)
    path = common.scratch(spark, "warc")
    warc.page_records(_table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).option("compress", "true").save()
    read = lambda kind, verify: spark.read.format("warc").option("verify", verify).option("payload", "false").load(path).filter(F.col("warc_type") == kind)
    back = read("response", "true").unionByName(read("revisit", "false"))
    told = back.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )
    told = common.cut(told)
    warc.remove(path)
    return told


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * k AS INT)) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines that an earlier one has; digest of the text that stays."""
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, and one of control strings, formatted and read back; digests of turns and loss text."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = chat.format_chat(turns)
    read = formatted.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '###', '\2'), '<|', '\3')) AS n,
    length(replace(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '###', '\2'), '<|', '\3'), chr(10), '\4')) AS r
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + r + 1 + n + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text."""
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, c:
    list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, c)), 4294967295), 4294967295)"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's periodic runs, one in ten documents with a planted one; the longest run, digests of all and of the collapsed text."""
    found = periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    told = found.withColumn("top", top)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.early")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.short")).alias("period"),
        F.expr("(1000 * top.length) div -top.short").alias("exponent_milli"),
        common.sha256_hex(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        common.sha256_hex(F.col("collapsed")).alias("collapsed_sha256"),
    )


OP11_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, """ + sql_crc32("CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents),
a AS (SELECT doc_id, ws, len(ws) AS n, h, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1 AS BIGINT)]) END AS ws FROM a),
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM p),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i <= x.i + x.n // 4),
g AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
c AS (SELECT * FROM g WHERE e - s >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.q < c.q AND b.s <= c.s AND b.e >= c.e)),
t AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'start': s, 'length': e - s, 'period': q}, {'l': s - e, 's': s, 'p': q}) AS top,
    string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS told
  FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN o ON o.doc_id = w.doc_id AND o.i = w.i WHERE o.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each damaged conversation's faults, the cost and audit of its cheapest repair, and a digest of the repaired turns."""
    return conversation_repair.repaired_report(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = (
    r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    """ + sql_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))") + r""" % 20 AS h
  FROM conversations),
x AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE h <> 0),
y AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM x),
r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    nth > 1 AND NOT blank AS dup, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM y),
n AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
m AS (  -- inserts (k) before a row that is kept or gets a role: state before, state it goes to, roles inserted
  SELECT * FROM (VALUES ('-', 's', 0, ''), ('-', 'u', 0, ''), ('-', 'a', 1, 'user:' || chr(10)), ('-', 'u', 2, 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('s', 'u', 0, ''), ('s', 'a', 1, 'user:' || chr(10)), ('s', 'u', 2, 'user:' || chr(10) || 'assistant:' || chr(10)),
    ('u', 'a', 0, ''), ('u', 'u', 1, 'assistant:' || chr(10)),
    ('a', 'u', 0, ''), ('a', 'a', 1, 'user:' || chr(10))) AS m(s, t, k, added)),
e AS (  -- each row's edits
  SELECT r.conv_id, r.i, m.s, m.t, 3 * m.k + CASE WHEN r.c = m.t THEN 0 ELSE 3 END + CASE WHEN cut THEN 3 ELSE 0 END AS cost,
    repeat('I', m.k) || CASE WHEN r.c = m.t THEN 'K' ELSE 'R' END AS audit,
    m.added || CASE WHEN r.c = m.t THEN r.role WHEN m.t = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text || chr(10) AS told
  FROM r JOIN m ON r.c = m.t OR m.t <> 's' WHERE NOT blank AND NOT dup
  UNION ALL SELECT r.conv_id, r.i, s, s, 4, 'D', '' FROM r CROSS JOIN (VALUES ('-'), ('s'), ('u'), ('a')) AS v(s)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '-' AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'told': ''} AS best FROM n
  UNION ALL
  SELECT conv_id, i, s, min(best) FROM (
    SELECT dp.conv_id, e.i, e.t AS s, {'cost': dp.best.cost + e.cost, 'audit': dp.best.audit || e.audit, 'told': dp.best.told || e.told} AS best
    FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.s = dp.s) GROUP BY conv_id, i, s),
f AS (
  SELECT dp.conv_id, min({'cost': best.cost + 3 * k, 'audit': best.audit || repeat('I', k), 'told': best.told || added}) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i
  JOIN (VALUES ('-', 0, ''), ('s', 2, 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 1, 'assistant:' || chr(10)), ('a', 0, '')) AS z(s, k, added) ON z.s = dp.s
  GROUP BY dp.conv_id),
q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.told, length(best.told) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id
"""
)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score, learned from the labels of documents not held out, and whether it reaches 0.7."""
    found = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", F.col("in_held_out").alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def packing_under_all_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing where each capacity binds: 4096 tokens, 12 pieces and the attention of 3072 tokens in one piece."""
    pieces = packing.tokenize_pieces(_table(spark, sf_dir, "documents"), max_tokens=3072).drop("ids")
    return packing.best_fit_pack(pieces, 4096, max_documents=12, max_attention=3072.0**2, weights=(1.0, 0.3, 0.3), rule="dot")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of the pipeline over all documents."""
    import corpus_pipeline  # the script at the top of the repository reads this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scans": op2_license_scans,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_classifier": op13_quality_classifier,
    "packing_under_all_capacities": packing_under_all_capacities,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_warc": OP8_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
