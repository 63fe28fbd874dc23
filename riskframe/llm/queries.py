"""The registered queries ``opN_<name>``, one per operator, and the SQL of
those that SQL can express. Each is a thin layer: it applies the operator to
the whole table and derives the agreed columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.frames import scratch_path
from riskframe.llm import (
    alignment,
    archive,
    chat,
    decontaminate,
    linededup,
    lm,
    merkle,
    mixing,
    puquality,
    quality,
    secrets,
    simhash,
    urls,
)
from riskframe.llm.common import ascii_lower


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_t(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return groups.select("doc_id", "fingerprint", "component_id")


#: The agreed rules, and fallback ones for known junk hosts.
URL_RULES = [
    urls.UrlRule("block", "net/"),
    urls.UrlRule("allow", "example.net/en/"),
    urls.UrlRule("block", "example.com/de/"),
    urls.UrlRule("allow", "org/fr/"),
    urls.UrlRule("block", "cheap-pills.example.*", fallback=True),
    urls.UrlRule("block", "spam-farm.example.*", fallback=True),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_t(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT *,
    ('.' || host) LIKE '%.net' AND path LIKE '/%' AS r1,
    ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' AS r2,
    ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' AS r3,
    ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' AS r4,
    regexp_matches('.' || host || path, '^[^/]*\.(cheap-pills|spam-farm)\.example\.[^/]*(/|$)') AS junk
  FROM parts)
SELECT page_id, host, path,
  CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
  CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r1 THEN 'block'
       WHEN junk THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""

#: Fixed value: a text that says the template's own control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    chats = chat.format_chats(turns.unionByName(extra))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = chat.with_loss_text(chats).select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        "loss",
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
near AS (
  SELECT *, lag(role) OVER w AS p, lead(role) OVER w AS n,
    length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?SYS\]|SEP\]|/?s>|/?SYS>>|\|im_start\|>|\|im_end\|>)', '\1\\\2\3', 'g')) AS c,
    length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?SYS\]|SEP\]|/?s>|/?SYS>>|\|im_start\|>|\|im_end\|>)', '\1\\\2\3', 'g')) AS r
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(c + CASE WHEN p IS NOT DISTINCT FROM role THEN 5 ELSE 9 + r END
             + CASE WHEN n IS NOT DISTINCT FROM role THEN 0 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive.write_archives(archive.page_records(_t(spark, sf_dir, "pages")), path)
    back = archive.read_archives(spark, path)
    return back.select(
        archive.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        # a response's digest is taken again from what was read
        F.when(F.col("record_type") == "response", F.sha2("payload", 256))
        .otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
        .alias("payload_digest"),
        "record_type",
        archive.page_of(F.col("refers_to")).alias("refers_to"),
    )


OP4_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM rows)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM least
"""


def _remainder(n: int):
    """crc32 of the doc_id's text, modulo n (null: of no text)."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _t(spark, sf_dir, "labels").where((F.col("quality") == 1) & (_remainder(3) != 1)).select("doc_id")
    scores = puquality.pu_scores(docs, trusted, train=_remainder(3) != 1)
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.lm_scores(docs.withColumn("train", _remainder(7) != 2))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), short_items=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs).select("doc_id", "secrets")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_t(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


OP10_SQL = """
WITH rows AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i
  FROM rows GROUP BY source),
ranked AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM src),
stepped AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
found AS (SELECT level FROM stepped WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN (SELECT count(*) FROM found) = 0 THEN cap ELSE least(cap, (SELECT level FROM found) * w) END AS target
  FROM stepped),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
grouped AS (
  SELECT source, h, sum(size) AS g FROM rows WHERE size > 0 GROUP BY ALL),
run AS (
  SELECT source, h, g, coalesce(sum(g) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM grouped),
bars AS (
  SELECT r.source, max(r.h) AS bar FROM run r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
  WHERE 2 * r.start + r.g <= 2 * (p.target - p.whole * p.source_size) AND p.target - p.whole * p.source_size > 0
  GROUP BY r.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN d.h <= b.bar THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN bars b ON d.source IS NOT DISTINCT FROM b.source
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("text", F.lit("")).cast("binary")
    return linededup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, UNNEST(string_split(t, chr(10))) AS line, UNNEST(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS t FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last_id AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    digest = lambda text: merkle.row_digest(*[text if c == "text" else F.col(c) for c in columns])
    lowered = _remainder(3) == 0
    shown = F.when(lowered, digest(ascii_lower(F.col("text"))))
    rows = merkle.merkle_manifest(docs, columns, carry={"shown": shown})
    folded = merkle.fold(F.coalesce("shown", "leaf"), F.col("proof"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
  FROM (SELECT UNNEST(range(256)) AS n)),
rows AS (
  SELECT doc_id, lang, text, source, n_chars,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS lowered
  FROM documents, crc),
parts AS (
  SELECT *,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM rows),
digests AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN lowered THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS shown
  FROM parts),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM digests),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n),
heights AS (SELECT lang, max(level) AS height FROM nodes GROUP BY lang),
subroots AS (
  SELECT n.lang, n.h AS subroot, e.height, row_number() OVER (ORDER BY n.lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes n JOIN heights e ON n.lang IS NOT DISTINCT FROM e.lang AND n.level = e.height),
tops AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, i // 8, n),
steps AS (
  SELECT lang, level, i, h, n, i // 8 AS p FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.lang, s.height + t.level, t.i, t.h, t.n, t.i // 8 FROM tops t, subroots s WHERE t.n > 1),
walks AS (
  SELECT l.lang, l.i AS leaf_i, e.level, CAST(floor(l.i / pow(8, e.level)) AS BIGINT) AS i
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) e ON l.lang IS NOT DISTINCT FROM e.lang
  UNION ALL
  SELECT l.lang, l.i, s.height + t.level, CAST(floor(s.i / pow(8, t.level)) AS BIGINT)
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, (SELECT DISTINCT level FROM tops WHERE n > 1) t),
sides AS (
  SELECT w.lang, w.leaf_i, w.level,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < w.i), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > w.i), '') AS after
  FROM walks w JOIN steps s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level AND w.i // 8 = s.p
  GROUP BY w.lang, w.leaf_i, w.level),
proofs AS (
  SELECT lang, leaf_i, list(struct_pack(before, after) ORDER BY level) AS proof,
    string_agg(before || after, '' ORDER BY level) AS text, count(*) AS depth
  FROM sides GROUP BY lang, leaf_i),
met AS (
  SELECT l.*, coalesce(p.proof, []) AS proof, coalesce(p.text, '') AS siblings, coalesce(p.depth, 0) AS depth
  FROM leaves l LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.i = p.leaf_i),
folds AS (
  SELECT lang, i, 0 AS level, shown AS h, proof, depth FROM met
  UNION ALL
  SELECT lang, i, level + 1, sha256(proof[level + 1].before || h || proof[level + 1].after), proof, depth FROM folds WHERE level < depth)
SELECT m.doc_id, m.leaf, s.subroot, t.h AS root, sha256(m.siblings) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM met m JOIN folds f ON m.lang IS NOT DISTINCT FROM f.lang AND m.i = f.i AND f.level = m.depth
JOIN subroots s ON m.lang IS NOT DISTINCT FROM s.lang, tops t WHERE t.n = 1
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, groups="sha256").withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL,
        "op3_chat_format": OP3_SQL,
        "op4_warc": OP4_SQL,
        "op10_mix": OP10_SQL,
        "op11_line_dedup": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL,
    }
