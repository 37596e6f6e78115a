"""The registered queries of the corpus operators, with production parameters.

Each reads whole tables, applies its operator and derives the digest columns from what the
operator returns. ``ORACLES`` holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywing.llm import (
    ann, bitpack, chat, decontam, divergence, fingerprints, html, neardup, packing, pii, quality, repair, urls)
from tallywing.session import materialize, work_dir

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_VOCABULARY = 50_257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


#: Formatted lengths follow from how many windows show a turn; roles in the table need no escapes.
OP3_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS size,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns),
marked AS (SELECT *, place = 1 AND role = 'system' AS is_system FROM sized),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) - size AS begin_at,
                  coalesce(sum(size) FILTER (WHERE is_system) OVER (PARTITION BY conv_id), 0) AS lead FROM marked),
widths AS (SELECT *, greatest(1024 - 256 - lead, 1) AS width FROM summed),
cells AS (SELECT *, CASE WHEN is_system THEN 0 ELSE (begin_at - lead) // width END AS cell FROM widths),
full_cells AS (SELECT conv_id, cell, max(place) AS last_place FROM cells WHERE NOT is_system
               GROUP BY conv_id, cell, width HAVING sum(size) > width AND count(*) > 1),
parts AS (SELECT c.*, 2 * c.cell + (f.last_place IS NOT NULL)::int AS part
          FROM cells c LEFT JOIN full_cells f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.cell = c.cell AND f.last_place = c.place),
windows AS (SELECT conv_id, part, max(begin_at + size) AS end_at, coalesce(sum(size) FILTER (WHERE NOT is_system), 0) AS own
            FROM parts GROUP BY conv_id, part),
followed AS (SELECT *, lead(own) OVER (PARTITION BY conv_id ORDER BY part) AS next_own,
                    count(*) OVER (PARTITION BY conv_id) - 1 AS n FROM windows),
shown AS (SELECT p.*, 1 + CASE WHEN is_system THEN n
                               ELSE (next_own IS NOT NULL AND end_at - begin_at <= 256
                                     AND p.lead + end_at - begin_at + next_own <= 1024)::int END AS times,
                 length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))
                 + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) AS chars
          FROM parts p JOIN followed f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.part = p.part),
told AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS all_text,
                coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS learnt,
                CAST(sum(times * chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars FROM told
"""


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for r, v in RULES],
                                  "host string, path string, rule string, verdict string")
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, rules, urls.alias_links(pages))


#: The given pages hold no redirect or canonical link, so no verdict comes from an alias here;
#: aliases are tested on fixtures.
OP4_SQL = r"""
WITH rules(host, path, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
    ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
rests AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS row_id, page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fits AS (SELECT row_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
         GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS why
FROM parts LEFT JOIN fits USING (row_id)
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pii.all_spans(docs, pii.fit(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
                        pii.told(F.col("spans")).alias("spans"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link_components(table(spark, sf_dir, "documents"), width=2, percent=80)
    return linked.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
          AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS seen FROM classes
          UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(p.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(p.component, d.doc_id) AS kept
FROM shingled d LEFT JOIN classes c ON c.s = d.s LEFT JOIN parts p ON p.node = c.rep
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialize(quality.features_table(table(spark, sf_dir, "documents")), "features")
    model = quality.learn(features, table(spark, sf_dir, "labels"))
    scored = features.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                             quality.score_column(model, F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-bits")
    bitpack.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER, 2, BYTE_VOCABULARY)
    return bitpack.read_tokens(spark, path)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by a checksum of conversation and turn."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    role = F.when(fate == 4, "user").otherwise(plain("role"))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    copies = F.when(fate == 3, 2).otherwise(1)
    return turns.filter(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                          F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    faulty = damaged(turns)
    found = materialize(repair.audits(faulty), "audits")
    left = repair.digests(repair.repaired_turns(faulty, found))
    given = turns.select(F.col("conv_id").alias("given")).distinct()
    rows = given.join(found, F.col("given").eqNullSafe(F.col("conv_id")), "left").drop("conv_id") \
        .join(left, F.col("given").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("given").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The edits by dynamic programming: per row the least (cost, audit) for each state s0 (nothing yet),
#: s1 (a system turn), s2 (a user turn last), s3 (an assistant turn last); strings are joined in order of rows.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
        ELSE c >> 1 END, n)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
dealt AS (SELECT g.*, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 AS fate FROM given g, crc_table),
faulty AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                  unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stem FROM faulty),
seen AS (SELECT *, min(i) OVER (PARTITION BY conv_id, role, text) AS first FROM placed),
told AS (SELECT *, CASE WHEN stem = '' THEN 'blank' WHEN i > first THEN 'duplicate'
                        WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
stepped AS (SELECT *, left(role, 1) AS own, fault IS NOT DISTINCT FROM 'blank' OR fault IS NOT DISTINCT FROM 'duplicate' AS must_go,
                   CASE WHEN fault IS NOT DISTINCT FROM 'truncated' THEN 1 ELSE 0 END AS extra,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM told),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
            FROM stepped GROUP BY conv_id),
search AS (
    SELECT conv_id, n, 0 AS i, {'c': 0, 'a': ''} AS s0, {'c': 1000000000, 'a': ''} AS s1, {'c': 2, 'a': 'I'} AS s2,
           {'c': 4, 'a': 'II'} AS s3 FROM counted
    UNION ALL
    SELECT conv_id, n, i, s0, s1, u AS s2, list_min([s3, {'c': u.c + 2, 'a': u.a || 'I'}]) AS s3
    FROM (SELECT conv_id, n, i, s0, s1, s3, list_min([s2, {'c': s0.c + 2, 'a': s0.a || 'I'}, {'c': s1.c + 2, 'a': s1.a || 'I'},
                                                      {'c': s3.c + 2, 'a': s3.a || 'I'}]) AS u
          FROM (SELECT s.conv_id, n, r.i, {'c': s0.c + 3, 'a': s0.a || 'D'} AS s0,
                       list_min([{'c': s1.c + 3, 'a': s1.a || 'D'},
                                 {'c': s0.c + CASE WHEN own = 's' AND NOT must_go THEN extra ELSE 1000000000 END, 'a': s0.a || 'K'}]) AS s1,
                       list_min([{'c': s2.c + 3, 'a': s2.a || 'D'},
                                 {'c': s0.c + CASE WHEN own = 'u' AND NOT must_go THEN extra ELSE 1000000000 END, 'a': s0.a || 'K'},
                                 {'c': s1.c + CASE WHEN own = 'u' AND NOT must_go THEN extra ELSE 1000000000 END, 'a': s1.a || 'K'},
                                 {'c': s3.c + CASE WHEN own = 'u' AND NOT must_go THEN extra ELSE 1000000000 END, 'a': s3.a || 'K'},
                                 {'c': s0.c + CASE WHEN must_go THEN 1000000000 ELSE extra + 2 END, 'a': s0.a || 'R'},
                                 {'c': s1.c + CASE WHEN must_go THEN 1000000000 ELSE extra + 2 END, 'a': s1.a || 'R'},
                                 {'c': s3.c + CASE WHEN must_go THEN 1000000000 ELSE extra + 2 END, 'a': s3.a || 'R'}]) AS s2,
                       list_min([{'c': s3.c + 3, 'a': s3.a || 'D'},
                                 {'c': s2.c + CASE WHEN own = 'a' AND NOT must_go THEN extra ELSE 1000000000 END, 'a': s2.a || 'K'},
                                 {'c': s2.c + CASE WHEN must_go THEN 1000000000 ELSE extra + 2 END, 'a': s2.a || 'R'}]) AS s3
                FROM search s JOIN stepped r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))),
best AS (SELECT conv_id, n, list_min([s0, s3]) AS b FROM search WHERE i = n),
letters AS (SELECT conv_id, unnest(string_split(b.a, '')) AS edit, unnest(range(1, length(b.a) + 1)) AS nth FROM best),
numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS row_no, count(*) FILTER (edit <> 'D') OVER w - 1 AS place,
                    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
             FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING)),
turned AS (SELECT l.conv_id, l.nth, CASE WHEN edit = 'K' THEN r.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
                  || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END AS line
           FROM numbered l LEFT JOIN stepped r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.row_no AND l.edit <> 'I'
           WHERE edit <> 'D'),
left_over AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY nth)) AS repaired_sha256 FROM turned GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.b.c, 0)::bigint AS cost,
       coalesce(b.b.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN left_over o ON o.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, sum(coalesce(u.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
                 k.n AS lang_n, l.n AS lang_total, l.v
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN used u USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, CAST(1 + 1000000000::hugeint * (n + 5) // (total + 5 * v) AS BIGINT) AS p,
                  CAST(1 + 1000000000::hugeint * (lang_n + 5) // (lang_total + 5 * v) AS BIGINT) AS q FROM dense),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
              FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.follow_up(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_permutation_index, op2_consensus_extraction, op3_chat_windows, op4_redirect_equivalence, op5_personal_data,
    op6_best_fit_packing, op7_minhash_near_dedup, op8_benchmark_decontamination, op9_quality_additive,
    op10_token_bits, op11_structure_repair, op12_source_divergence, op13_document_fingerprints)}
ORACLES: dict[str, str] = {"op3_chat_windows": OP3_SQL, "op4_redirect_equivalence": OP4_SQL,
                           "op7_minhash_near_dedup": OP7_SQL,
                           "op11_structure_repair": OP11_SQL, "op12_source_divergence": OP12_SQL}
