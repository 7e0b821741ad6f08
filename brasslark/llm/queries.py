"""The queries of this subpackage: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasslark.llm import chat, exact, html, langid, minhash, mixing, packing, phrases, quality, simhash, toxicity, trie, urls
from brasslark.llm.common import saved, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_copies(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the listed rules' verdicts: the table labels is of documents and says nothing about a URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table goes through a fresh index in two batches, so the second meets what the first brought."""
    index = exact.DigestIndex.temporary(spark)
    rows = exact.dedup_in_batches(table(spark, sf_dir, "documents"), index, 2, "documents")
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_next(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are turns; conversation -7 comes as a record with a list of messages."""
    said = "\\### Assistant: </turn> ok"
    extra = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(extra)).alias("record"))
    return chat.digests(chat.written(chat.turn_records(table(spark, sf_dir, "conversations")).union(extra)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    conv = F.col("conv_id")
    return trie.trie(*trie.grafted(turns, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_toxicity, op3_url_filter, op4_simhash, op5_language, op6_best_fit, op7_html, op8_exact_dedup, op9_order_minhash, op10_quality, op11_chat_format, op12_prefix_trie, op13_collocations)}

ORACLES = {
    "op1_mix_sources": r"""
        WITH rows AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest
            FROM documents
        ), per AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
            FROM rows GROUP BY source
        ), weighed AS (
            SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
                   CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM per
        ), ordered AS (
            SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS k FROM weighed
        ), levels AS (
            SELECT a.k, a.cap, a.weight,
                   ((SELECT 1.5::DOUBLE * sum(source_size) FROM weighed) - coalesce((SELECT sum(b.cap) FROM ordered b WHERE b.k < a.k), 0.0))
                   / (SELECT sum(b.weight) FROM ordered b WHERE b.k >= a.k) AS level
            FROM ordered a
        ), level AS (
            SELECT level FROM levels WHERE cap >= level * weight ORDER BY k LIMIT 1
        ), targets AS (
            SELECT source, source_size, least(cap, (SELECT level FROM level) * weight) AS target,
                   CAST(('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
            FROM weighed
        ), ranked AS (
            SELECT r.doc_id, r.size, t.source_size, t.target, t.shift,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
                   row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.digest, r.doc_id) AS rank
            FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(least(floor(rate * rank + shift) - floor(rate * (rank - 1) + shift), 2) AS BIGINT) * size AS taken
        FROM ranked""",
    "op8_exact_dedup": """
        WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM rows JOIN groups USING (text_sha256)""",
    "op11_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '_\0', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '_\0', 'g'))) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op12_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                   sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
                   len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens
            FROM conversations WHERE conv_id IS NOT NULL
        ), crc AS (
            SELECT i, list_reduce([CAST(i AS UBIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) x(i)
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS name FROM (SELECT DISTINCT conv_id FROM turns)
        ), steps AS (
            SELECT conv_id, base, name, (WITH RECURSIVE r(k, c) AS (
                SELECT 0, CAST(4294967295 AS UBIGINT)
                UNION ALL SELECT k + 1, xor(c // 256, (SELECT CAST(t AS UBIGINT) FROM crc WHERE i = xor(c % 256, CAST(ascii(substr(name, CAST(k + 1 AS INTEGER), 1)) AS UBIGINT)))) FROM r WHERE k < length(name)
            ) SELECT xor(max_by(c, k), 4294967295) % 4 FROM r) AS h
            FROM convs
        ), taken AS (
            SELECT s.conv_id, t.pos, t.turn, t.tokens FROM steps s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.h
        ), most AS (
            SELECT s.conv_id, s.h, coalesce((SELECT count(*) FROM taken t WHERE t.conv_id = s.conv_id), 0) AS m FROM steps s
        ), rebuilt AS (
            SELECT * FROM taken
            UNION ALL SELECT t.conv_id, m.m + t.pos - m.h, t.turn, t.tokens FROM turns t JOIN most m USING (conv_id) WHERE t.pos > m.h
        ), paths AS (
            SELECT conv_id, 0 AS pos, '' AS seq, 0 AS tokens FROM convs
            UNION ALL SELECT conv_id, pos, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY pos), tokens FROM rebuilt
        ), sizes AS (
            SELECT conv_id, max(pos) AS size FROM paths GROUP BY conv_id
        ), named AS (
            SELECT p.*, min(p.conv_id) OVER (PARTITION BY p.pos, p.seq) AS node, count(*) OVER (PARTITION BY p.pos, p.seq) AS n, s.size = p.pos AS ends
            FROM paths p JOIN sizes s USING (conv_id)
        ), nodes AS (
            SELECT b.pos, b.node, a.node AS above, max(b.n) AS n, max(b.tokens) AS tokens, string_agg(CAST(b.conv_id AS VARCHAR), ',' ORDER BY b.conv_id) FILTER (b.ends) AS ids
            FROM named b LEFT JOIN named a ON a.conv_id = b.conv_id AND a.pos = b.pos - 1 GROUP BY b.pos, b.node, a.node
        ), own AS (
            SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.pos = n.pos + 1 AND k.above = n.node) AS n_children FROM nodes n
        ), under AS (
            SELECT a.pos, a.node, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n - 1) * o.tokens) AS saved
            FROM own o JOIN named a ON a.conv_id = o.node AND a.pos <= o.pos GROUP BY a.pos, a.node
        )
        SELECT o.node AS conv_id, CAST(o.pos AS BIGINT) AS depth, o.above AS parent_conv_id, o.n AS n_convs, o.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(o.ids, '')) AS ends_sha256
        FROM own o JOIN under u ON u.pos = o.pos AND u.node = o.node""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
            )
        ), firsts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
        ), grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM firsts, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(w)
        ), totals AS (
            SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
        ), f AS (
            SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 30
        ), cuts AS (
            SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
        ), low AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored) WHERE place = 1
        ), spans AS (
            SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM f WHERE k > 2
        ), inside AS (
            SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM spans) GROUP BY ALL
        ), best AS (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
            FROM low s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a
        )
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best JOIN totals USING (lang) WHERE rank <= 2000""",
}
