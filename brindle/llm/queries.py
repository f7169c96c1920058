"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import chat, decontaminate, exact_dedup, licenses, mix, quality, repeats, simhash, toxicity, warc
from brindle.llm.common import held_out, written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_read(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_read(spark, sf_dir, "documents"), out="found", keep=["doc_id"])
    return found.select("doc_id", "found.n_bytes", "found.n_removed", F.size("found.spans").cast("long").alias("n_spans"), F.sha2("found.kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, _read(spark, sf_dir, "benchmark"), out="found", keep=["doc_id"])
    items = F.array_sort("found.items")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated("found").alias("contaminated"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(_read(spark, sf_dir, "documents"), out="found", keep=["doc_id"]).withColumn("found", licenses.best(F.col("found")))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    return found.select(
        "doc_id",
        F.array_join(names, ",").alias("licenses"),
        F.size(names).cast("long").alias("n_licenses"),
        F.array_min(F.transform("found", lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform("found", lambda m: m["containment"])).alias("containment"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    found = toxicity.with_score(docs, model, out="found", keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.score", toxicity.toxic("found").cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    found = quality.with_grade(docs, model, out="found", keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.expected_grade", "found.tail", quality.selected("found").alias("selected"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_read(spark, sf_dir, "pages"))
    return warc.read_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONTROL_TEXT).alias("text"))
    out = written(chat.format_chats(rows.unionByName(added)), "chats")
    back = out.select("conv_id", "state", "complete", chat.formatted(F.col("segments")).alias("formatted"), chat.loss_text(F.col("segments")).alias("loss"))
    back = back.withColumn("turns", chat.parsed(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "complete",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_repeats, op3_simhash, op4_decontaminate, op5_exact_dedup, op6_licenses, op7_toxicity, op8_quality, op9_warc, op10_chat)}


def _chat_sql() -> str:
    t = chat.Template()
    escaped = "text"
    for old, new in t.pairs():
        escaped = f"replace({escaped}, '{old}', '{new}')"
    frame = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(x.before) + len(x.after)}" for r, x in t.turns.items())
    steps = " ".join(f"WHEN '{state} {role}' THEN '{to}'" for (state, role), to in t.transitions.items())
    final = ", ".join(f"'{x}'" for x in t.final)
    frame += f" ELSE {len(t.other.before) + len(t.other.after) + len(t.role_end)} + length(role) END"
    return f"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{_CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL_TEXT}'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               ({len(t.start)} + sum({frame} + length({escaped})))::BIGINT AS formatted_chars,
               list_reduce(list_prepend('start', list(role ORDER BY turn, role, text)), lambda s, r: CASE s || ' ' || r {steps} ELSE 'error' END) AS state,
               state IN ({final}) AS complete
        FROM rows GROUP BY conv_id"""


#: The oracle takes rows by a running sum in hash order, which the operator never computes.
_MIX_SQL = r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
        FROM d GROUP BY source),
    c AS (
        SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total,
               coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
               sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
        FROM s),
    l AS (SELECT *, (total - before) / ahead AS own FROM c),
    m AS (SELECT *, max(CASE WHEN cap >= own * w THEN own END) OVER () AS level FROM l),
    t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM m),
    k AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
    r AS (
        SELECT d.doc_id, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rest,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
        FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN upto <= rest AND whole < 3 THEN 1 ELSE 0 END))::BIGINT AS taken,
           (whole + CASE WHEN upto <= rest AND whole < 3 THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM r"""

_EXACT_SQL = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AND copy = 1 AS kept, text_sha256 FROM g"""

_WARC_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM f"""


#: Windows of all documents and items are compared as texts; suffix arrays play no part.
_DECONTAMINATE_SQL = r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    asked AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT k FROM asked),
    places AS (
        SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS s
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM words, sizes WHERE len(w) >= k)),
    hits AS (SELECT p.r, p.j, p.k, a.item_id FROM places p JOIN asked a ON p.k = a.k AND p.s = a.s),
    covered AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS i FROM (SELECT DISTINCT r, j, k FROM hits)) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

#: Every 400-byte window's MD5 is counted.  Texts are hexadecimal and go in blocks, as substr() reads a text from its start.
_REPEATS_SQL = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
    blocks AS (SELECT r, b0, substr(h, 2 * b0 + 1, 2 * 1399) AS b FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399, 1000)) AS b0 FROM d WHERE len(h) >= 800)),
    places AS (SELECT r, b0 + k AS i, md5_number(substr(b, 2 * k + 1, 800)) AS m FROM (SELECT r, b0, b, unnest(range(0, len(b) // 2 - 399)) AS k FROM blocks)),
    twice AS (SELECT m FROM places GROUP BY m HAVING count(*) > 1),
    marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM places SEMI JOIN twice USING (m)),
    spans AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
    gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM spans),
    cut AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head FROM gaps JOIN d USING (r) GROUP BY r)
    SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN cut USING (r)"""


def _licenses_sql() -> str:
    """An inverted index of the templates' shingles, counted by window; MinHash plays no part."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    templates, shingles = [], []
    for kind, group in licenses.kinds_of(licenses.TEMPLATES).items():
        for name, own in group:
            t = len(templates)
            templates.append(f"({t}, {licenses.number_of(own)}, {text(name)}, {kind.shingle}, {len(own)}, {kind.stride}, {kind.width})")
            shingles += [f"({t}, {text(s)})" for s in own]
    rivals = ", ".join(f"({a}, {b}, {share!r}::DOUBLE)" for a, b, share in licenses.rivals_of(licenses.TEMPLATES))
    return rf"""
    WITH t(t, number, name, k, n, stride, width) AS (VALUES {", ".join(templates)}),
    own(t, s) AS (VALUES {", ".join(shingles)}),
    rivals(a, b, share) AS (VALUES {rivals}),
    d AS (
        SELECT doc_id, row_number() OVER () AS r,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    places AS (
        SELECT r, k, j, array_to_string(w[j + 1:j + k], ' ') AS s
        FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
    found AS (SELECT p.r, t.*, p.j, p.s FROM places p JOIN own ON own.s = p.s JOIN t ON t.t = own.t AND t.k = p.k),
    windows AS (SELECT *, unnest(range(ceil(greatest(j - width + 1, 0) / stride)::BIGINT, j // stride + 1)) * stride AS i FROM found),
    counted AS (SELECT * FROM (SELECT r, t, number, name, k, width, i, count(DISTINCT s) / n AS c FROM windows GROUP BY r, t, number, name, k, n, width, i) WHERE c >= {licenses.LEAST}),
    m AS (SELECT c.*, least(width, len(w) - k + 1 - i) + k - 1 AS n_words FROM counted c JOIN d USING (r)),
    kept AS (
        SELECT * FROM m WHERE NOT EXISTS (
            SELECT 1 FROM m o, rivals WHERE o.r = m.r AND a = o.number AND b = m.number AND o.i < m.i + m.n_words AND m.i < o.i + o.n_words AND o.c >= m.c AND m.c <= share + 1e-9))
    SELECT d.doc_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, count(DISTINCT name) AS n_licenses, min(i)::BIGINT AS first_word, max(c) AS containment
    FROM d LEFT JOIN kept ON kept.r = d.r GROUP BY d.r, d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": _MIX_SQL, "op2_repeats": _REPEATS_SQL, "op4_decontaminate": _DECONTAMINATE_SQL, "op6_licenses": _licenses_sql(), "op5_exact_dedup": _EXACT_SQL, "op9_warc": _WARC_SQL, "op10_chat": _chat_sql()}
