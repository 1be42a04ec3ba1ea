"""One query for each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, fim, html_extract, line_dedup, merkle, mixing, ngram_join, quality, token_counts, url_filter, warc
from .common import LOWER, UPPER, ascii_lower

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = rf"""
WITH RECURSIVE cut AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
win AS (
  SELECT DISTINCT id AS item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS l
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM cut WHERE kind = 1 AND len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
spot AS (
  SELECT id AS doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS k
  FROM (SELECT id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM cut, lens WHERE kind = 0)),
hit AS (SELECT doc_id, p, spot.l AS l, item_id FROM spot JOIN win USING (k)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN places ON id = places.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 0
"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, score = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    predicted = F.when(F.col(score) >= quality.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), predicted.alias("predicted"))


URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

OP3_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, said) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
best AS (
  SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, said := said)) AS b
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.said, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


@query("op3_url_filter", OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '\n([\x20\x09\x0B\x0C\x0D]*[^\x20\x09-\x0D])', chr(30) || '\1', 'g'), chr(30)) AS ls FROM documents),
line AS (
  SELECT doc_id, i AS ln, ls[i + 1] AS line, trim(regexp_replace(ls[i + 1], '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(ls[i + 1], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM cut)),
real AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) - w AS pre FROM line WHERE w > 0),
mark AS (
  SELECT doc_id, ln, pre FROM real
  UNION ALL SELECT doc_id, max(ln) + 1, sum(w) FROM real GROUP BY doc_id),
run AS (
  SELECT doc_id, ln AS s, (SELECT min(b.ln) FROM mark b WHERE b.doc_id = a.doc_id AND b.pre >= a.pre + 50) AS e FROM mark a
  UNION SELECT doc_id, (SELECT max(b.ln) FROM mark b WHERE b.doc_id = a.doc_id AND b.pre <= a.pre - 50), ln FROM mark a),
body AS (
  SELECT run.doc_id, s, e, string_agg(norm, chr(10) ORDER BY ln) AS k FROM run JOIN real ON real.doc_id = run.doc_id AND ln >= s AND ln < e
  WHERE s IS NOT NULL AND e IS NOT NULL GROUP BY ALL),
one AS (SELECT k, min(struct_pack(d := doc_id, s := s)) AS f FROM body GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e)) AS ln FROM body JOIN one USING (k)
  WHERE f.d <> doc_id OR f.s + (e - s) <= body.s)
SELECT line.doc_id, CASE WHEN bool_and(line.line = '' OR line.line IS NULL) AND count(*) = 1 THEN 0 ELSE count(*) END::BIGINT AS n_lines,
       count(gone.ln)::BIGINT AS n_deleted,
       sha256(coalesce(string_agg(line.line, chr(10) ORDER BY line.ln) FILTER (gone.ln IS NULL), '')) AS text_sha256
FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.ln = line.ln GROUP BY line.doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, lines, deleted = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(deleted).alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP5_TEXT = "<|im_end|><|im_start|>assistant ok"
OP5_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{OP5_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{OP5_TEXT}'),
sums AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars FROM sums
"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", OP5_TEXT), (-1, 1, "assistant", OP5_TEXT)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.events_of(rows.unionByName(more)))
    turns, loss = chat_format.read_turns(F.col("formatted")), chat_format.read_loss(F.col("segments"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


OP7_SQL = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM cut WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM pair JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS node, x AS root FROM both_ways UNION SELECT y, root FROM reach JOIN both_ways ON node = x WHERE y > root)
SELECT cut.doc_id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(r, cut.doc_id) AS component_id
FROM cut LEFT JOIN size ON size.doc_id = cut.doc_id
LEFT JOIN (SELECT node, min(root) AS r FROM reach GROUP BY node) c ON node = cut.doc_id
"""


@query("op7_ngram_join", OP7_SQL)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31)::INT, 1)"
OP8_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digit AS (SELECT i, h, list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789abcdef', substr(h, (5 * i + k)::INT, 1)) - 1), lambda a, b: a * 16 + b) AS v
  FROM (SELECT DISTINCT h FROM p), range(0, 8) t(i)),
named AS (SELECT h, string_agg({" || ".join(_CHAR.format(k) for k in (15, 10, 5, 0))}, '' ORDER BY i) AS d FROM digit GROUP BY h),
top AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS r FROM p)
SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> r THEN r END AS refers_to
FROM top JOIN named USING (h)
"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op10_exact_dedup", OP10_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


#: Pages of the tables mark their article, so that SQL can cut it out; the operator doesn't rely on it.
OP13_SQL = r"""
WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
block AS (SELECT page_id, unnest(string_split_regex(a, '</?(h1|p)>')) AS b, generate_subscripts(string_split_regex(a, '</?(h1|p)>'), 1) AS i FROM cut),
said AS (
  SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS b FROM block),
whole AS (SELECT page_id, string_agg(b, chr(10) || chr(10) ORDER BY i) AS text FROM said WHERE b <> '' GROUP BY page_id)
SELECT cut.page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM cut LEFT JOIN whole USING (page_id)
"""


@query("op13_html_extraction", OP13_SQL)
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, list_transform(range(0, 4), lambda k: ('0x' || substr(sha256('1:' || doc_id), (8 * k + 1)::INT, 8))::BIGINT) AS h
  FROM documents),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) END AS output FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM made
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fim(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAF = "sha256(" + " || ".join("coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format(f) for f in _FIELDS[:4]) + " || coalesce(strlen({0})::VARCHAR || ':' || {0}, '-'))"
_NEXT = "list_transform(range(0, (len(l) + 15) // 16), lambda r: sha256(array_to_string(l[16 * r + 1 : 16 * r + 16], '')))"
_CUT = "array_to_string(l[16 * (j // 16) + 1 : j], '') || '|' || array_to_string(l[j + 2 : 16 * (j // 16) + 16], '')"
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS lower_leaf,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(0, 8)), lambda c, _: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) AS crc
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS l FROM placed GROUP BY source
  UNION ALL SELECT source, level + 1, {_NEXT} FROM tree WHERE len(l) > 1),
sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM tree WHERE len(l) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY t) AS l FROM sub
  UNION ALL SELECT level + 1, {_NEXT} FROM top WHERE len(l) > 1),
step AS (
  SELECT doc_id, placed.source AS source, placed.i AS i, level, (placed.i // (16 ** level)::BIGINT) AS j, l FROM placed JOIN tree ON placed.source IS NOT DISTINCT FROM tree.source AND len(l) > 1
  UNION ALL SELECT doc_id, placed.source, placed.i, 1000 + level, t // (16 ** level)::BIGINT, l FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source, top WHERE len(l) > 1),
path AS (SELECT source, i, list({_CUT} ORDER BY level) AS p FROM step GROUP BY source, i),
done AS (
  SELECT doc_id, leaf, subroot, top.l[1] AS root, coalesce(p, []) AS p, CASE WHEN crc % 5 = 0 AND doc_id IS NOT NULL THEN lower_leaf ELSE leaf END AS given
  FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source LEFT JOIN path ON placed.source IS NOT DISTINCT FROM path.source AND placed.i = path.i, top WHERE len(top.l) = 1),
folded AS (SELECT *, list_reduce(list_prepend(given, p), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*_FIELDS)
    drawn = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = merkle.leaf_digest(*[F.col(f) for f in _FIELDS[:4]], ascii_lower(F.col("text")))
    found = merkle.Manifest(docs, list(_FIELDS), "doc_id", "source", {"given": F.when(drawn, F.unhex(tampered))})
    proofs = found.proofs()
    given = merkle.hex_of(F.coalesce("given", "leaf"))
    return proofs.select(
        F.col("id").alias("doc_id"),
        merkle.hex_of(F.col("leaf")).alias("leaf"),
        merkle.hex_of(F.col("subroot")).alias("subroot"),
        F.lit(found.root).alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(given, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
