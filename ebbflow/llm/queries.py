"""The registered queries of this subpackage and the SQL that DuckDB runs for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import chat, decontamination, fim, ngram_join, packing, pii, prefix_trie, secrets, suffix_dedup, syncmers, token_counts, token_files, toxicity
from ebbflow.llm.common import documents, materialize, read_table, shared_path

CAPACITY = 2048
TOKEN_LIMIT = 1024


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), CAPACITY, end_id=0)
    placed = packing.pack(materialize(token_files.with_crc32(pieces), "pieces"), CAPACITY)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def learning_rows() -> Column:
    """Rows whose label may be learnt from."""
    return _fold() != 0


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def _fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.train(docs), keep=["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text(F.col("pii.base")), 256).alias("base_sha256"),
                        text(F.col("pii.spans")).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learning_rows())
    scored = toxicity.score(docs, model, keep=["doc_id"])
    score = F.col("toxicity.score")
    return scored.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("predicted"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_next(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.annotate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    spans = F.col("decontamination.hit_spans")
    # ends less begins: every second word position counts positively
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    items = F.col("decontamination.items")
    return found.select("doc_id", F.col("decontamination.n_words").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    kept = F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=2)
    rows = token_files.with_crc32(token_files.read_tokens(spark, path))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    messages = chat.fold(chat.events_of_turns(turns.unionByName(extra)))
    path = shared_path(spark, "chat")
    chat.write_chat(chat.render(messages), path)
    return chat.digest(spark, path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir), keep=["doc_id"])
    restored = fim.restore(F.col("fim.output"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir), keep=["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(text(F.col("secrets.base")), 256).alias("base_sha256"),
                        text(F.col("secrets.spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    shared = F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 9
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), conv_id - conv_id % 5, shared, most_shared=8)


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + length(regexp_replace(text, '</?s>|[<\[]/?INST\]|<</?SYS>>|<\|[^|<>]*\|>', '\0' || chr(1), 'g')) - length(text) AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 1 + 12 + 10 + 1 + escaped)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(s) WHERE len(w) > 0),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM common JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT r, r AS s FROM size
  UNION SELECT reach.r, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.s)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN size ON size.r = d.r LEFT JOIN reach ON reach.r = d.r LEFT JOIN d o ON o.r = reach.s
GROUP BY d.r, d.doc_id, size.n
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, w[s:s + least(10, len(w)) - 1] AS win
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
pos AS (SELECT r, s, n, w[s:s + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hit AS (SELECT r, s, n, item_id FROM pos JOIN win USING (win)),
hit_words AS (SELECT r, count(DISTINCT i) AS n_hit FROM hit, unnest(range(s, s + n)) u(i) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

OP13_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
turns AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations),
convs AS MATERIALIZED (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS b,
    (SELECT xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ''), ''), lambda x: coalesce(ord(nullif(x, '')), 999)::UBIGINT),
      lambda crc, x: CASE WHEN x = 999 THEN crc ELSE xor(crc // 256, t[(xor(crc % 256, x) + 1)::BIGINT]) END), 4294967295::UBIGINT) FROM crc_table) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c, 0 AS part, pos, role, text FROM convs JOIN turns ON turns.conv_id = b AND pos <= h
  UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns ON turns.conv_id IS NOT DISTINCT FROM c AND pos > h),
rebuilt AS MATERIALIZED (
  SELECT convs.c, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS s
  FROM convs LEFT JOIN parts ON parts.c IS NOT DISTINCT FROM convs.c GROUP BY convs.c),
prefix AS MATERIALIZED (SELECT c, len(s) AS n, d, s[1:d] AS p FROM rebuilt, unnest(range(0, len(s) + 1)) u(d)),
node AS MATERIALIZED (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(octet_length(encode(p[d].text)), 0) AS saves,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefix GROUP BY d, p),
child AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
flagged AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.d = node.d AND child.p = node.p),
below AS (
  SELECT u.d, v.p[1:u.d] AS p, sum(saves) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM flagged v, unnest(range(0, v.d + 1)) u(d) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves,
  below.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM flagged f JOIN below ON below.d = f.d AND below.p = f.p LEFT JOIN node parent ON parent.d = f.d - 1 AND parent.p = f.p[1:f.d - 1]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_syncmers": op5_syncmers,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_files": op9_token_files,
    "op10_chat_format": op10_chat_format,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_secrets": op12_secrets,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op6_decontamination": OP6_SQL, "op10_chat_format": OP10_SQL,
                              "op13_prefix_trie": OP13_SQL}
