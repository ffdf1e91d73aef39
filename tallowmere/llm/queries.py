"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, licenses, media, mixing, quality, search, simhash, substrings, toxicity, trie, urls
from .shared import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copy_report(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("url")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_classifier, op2_media_copies, op3_licenses, op4_url_filter, op5_toxicity, op6_bpe, op7_mixing, op8_chat_format, op9_exact_dedup, op10_simhash,
    op11_conversation_trie, op12_ranked_search, op13_substring_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op4_url_filter": r"""
        WITH RECURSIVE r(own, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                                 ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        p AS (SELECT row_number() OVER () AS n, page_id, url, html FROM pages),
        tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|$)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)', ' ', 'g'), '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM p),
        attributes AS (
            SELECT url, lower(tag[2:5]) AS kind, list_transform(found, lambda x: lower(regexp_extract(x, '^[^\s=]+'))) AS names,
                   list_transform(found, lambda x: regexp_replace(regexp_extract(x, '(?s)^[^\s=]+\s*=\s*(.*)$', 1), '(?s)^(?:"(.*)"|''(.*)'')$', '\1\2')) AS vals
            FROM (SELECT url, tag, regexp_extract_all(regexp_replace(tag, '(?i)^<(link|meta)|>$', ' ', 'g'), '(?is)[^\s"''<>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?') AS found FROM tags)),
        named AS (
            SELECT url, CASE
                WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(vals[list_position(names, 'rel')]), '\s+'), 'canonical') THEN vals[list_position(names, 'href')]
                WHEN kind = 'meta' AND lower(trim(vals[list_position(names, 'http-equiv')])) = 'refresh' THEN regexp_extract(vals[list_position(names, 'content')], '(?is)(?:^|[\s;,])url\s*=\s*["'']?([^\s"'']+)', 1) END AS target
            FROM attributes),
        refs AS (
            SELECT url, regexp_split_to_array(target, '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});') AS texts,
                   list_transform(regexp_extract_all(target, '&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});', 1), lambda r: CASE
                       WHEN regexp_matches(r, '^#[xX]') THEN chr(('0x' || r[3:])::INT) WHEN starts_with(r, '#') THEN chr(r[2:]::INT)
                       ELSE coalesce(list_value('&', '&', '<', '>', '"', '''', '/', ':', '?', '#', '=', '.', '%', '+', '@', '_')[list_position(list_value('amp', 'AMP', 'lt', 'gt', 'quot', 'apos', 'sol', 'colon', 'quest', 'num', 'equals', 'period', 'percnt', 'plus', 'commat', 'lowbar'), r)], '&' || r || ';') END) AS chars
            FROM named WHERE target IS NOT NULL),
        links AS (SELECT * FROM (SELECT url, trim(array_to_string(list_transform(texts, lambda x, i: x || coalesce(chars[i], '')), '')) AS t FROM refs) WHERE t <> ''),
        local AS (
            SELECT *, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
                   CASE WHEN starts_with(t, '/') THEN t WHEN path = '' THEN '/' || t ELSE regexp_extract(path, '^(.*/)', 1) || t END AS place
            FROM links),
        whole AS (
            SELECT url, CASE
                WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN CASE WHEN contains(t, '://') THEN t END
                WHEN starts_with(t, '//') THEN scheme || ':' || t
                WHEN host = '' THEN NULL
                WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t
                WHEN t = '' OR starts_with(t, '#') THEN NULL
                ELSE scheme || '://' || host || list_reduce(string_split(regexp_replace(regexp_extract(place, '^([^?#]*)', 1), '/(\.\.?)$', '/\1/'), '/'),
                        lambda so_far, part: CASE part WHEN '..' THEN regexp_replace(so_far, '/[^/]*$', '') WHEN '.' THEN so_far ELSE so_far || '/' || part END)
                     || regexp_extract(place, '^[^?#]*(.*)$', 1) END AS t
            FROM local),
        urls AS (SELECT url FROM p UNION SELECT t FROM whole WHERE t IS NOT NULL),
        nodes AS (
            SELECT url, CASE WHEN host <> '' THEN scheme || '://' || regexp_replace(host, CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS node
            FROM (SELECT url, translate(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
                         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM urls)),
        e AS (SELECT a.node AS u, b.node AS v FROM whole JOIN nodes a ON a.url = whole.url JOIN nodes b ON b.url = whole.t WHERE a.node <> b.node),
        g AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        reach AS (SELECT u AS a, u AS z FROM g UNION SELECT a, g.v FROM reach JOIN g ON g.u = z),
        judged AS (
            SELECT key, url, host, path, f.rule, f.own
            FROM (SELECT key, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
                  FROM (SELECT n::VARCHAR AS key, url FROM p UNION ALL SELECT DISTINCT u, u FROM g)) x
            LEFT JOIN LATERAL (
                SELECT rh || rp AS rule, own FROM r
                WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) f ON true),
        m AS (SELECT a, bool_or(own = 'allow') AS allow, bool_or(own = 'block') AS block FROM reach JOIN judged ON judged.key = z GROUP BY a)
        SELECT page_id, host, path, rule, coalesce(own, CASE WHEN block AND NOT allow THEN 'block' ELSE 'allow' END) AS verdict
        FROM p JOIN judged ON judged.key = p.n::VARCHAR LEFT JOIN nodes ON nodes.url = p.url LEFT JOIN m ON m.a = nodes.node""",
    "op8_chat_format": r"""
        WITH t AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, 'none ' || md5(coalesce(role, 'unknown')) || md5(coalesce(text, ''))) AS unit, conv_id,
                          CASE WHEN conv_id IS NOT NULL THEN turn END AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        l AS (SELECT unit, conv_id, row_number() OVER o AS place,
                     string_agg(md5(role) || md5(text), '/') OVER o AS prefix,
                     string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '') OVER o AS rendered,
                     count(*) OVER (PARTITION BY unit) AS n_turns
              FROM t WINDOW o AS (PARTITION BY unit ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)),
        w AS (SELECT * FROM l WHERE place = n_turns)
        SELECT w.conv_id, w.n_turns, w.rendered FROM w JOIN (
            SELECT prefix, min(conv_id) AS conv_id, min(unit) FILTER (conv_id IS NULL) AS unit FROM w
            WHERE prefix NOT IN (SELECT prefix FROM l WHERE place < n_turns) GROUP BY prefix) k
        ON w.unit = coalesce(k.conv_id::VARCHAR, k.unit)""",
    "op3_licenses": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        j AS (SELECT doc_id, len(ws) AS n_words, ws, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM d),
        b(phrase, label) AS (VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')),
        p AS (SELECT doc_id, label, i - 1 AS word
              FROM (SELECT doc_id, ws, n_words, unnest(range(1, n_words + 1)) AS i FROM j
                    WHERE contains(s, ' cc by ') OR contains(s, ' general public license ') OR contains(s, ' all rights reserved ')) x
              JOIN b ON ws[i] = string_split(phrase, ' ')[1] AND array_to_string(ws[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
        t(label, pattern) AS (VALUES {templates}),
        m AS (SELECT DISTINCT doc_id, label FROM j JOIN t ON regexp_matches(s, pattern)),
        g AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
        h AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT * FROM m) GROUP BY doc_id)
        SELECT j.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN j.doc_id IN (SELECT doc_id FROM m) THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM j LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)""".replace("{templates}", licenses.sql_values()),
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                     source_size * 3 AS cap FROM s),
        c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps,
                     sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM w),
        l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - caps) / rest AS level FROM c),
        v AS (SELECT first(level ORDER BY cap / weight, source ASC NULLS LAST) AS level FROM l WHERE weight * level <= cap),
        t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT level FROM v)), 0.0) AS target FROM w),
        u AS (SELECT d.*, source_size, target,
                     sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        o AS (SELECT u.*, (upto + p.pass * source_size)::DOUBLE / target AS finish
              FROM u JOIN (SELECT unnest([0, 1, 2]) AS pass) p ON p.pass < least(ceil(target / source_size), 3)
              WHERE size > 0 AND target > 0),
        e AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, k ROWS UNBOUNDED PRECEDING) AS upto_all FROM o),
        n AS (SELECT source, doc_id, k, upto, count(*) AS copies FROM e WHERE upto_all <= (SELECT sum(size) FROM d) GROUP BY ALL)
        SELECT u.doc_id, u.size, u.source_size, u.target, (u.size * coalesce(n.copies, 0))::BIGINT AS taken, u.source,
               coalesce(n.copies, 0)::BIGINT AS copies
        FROM u LEFT JOIN n ON u.source IS NOT DISTINCT FROM n.source AND u.k = n.k AND u.upto = n.upto
                          AND u.doc_id IS NOT DISTINCT FROM n.doc_id""",
    "op11_conversation_trie": r"""
        WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
                          strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
                   FROM conversations WHERE conv_id IS NOT NULL),
        bits(n, x) AS (SELECT n, list_reduce([n::UBIGINT] || range(8)::UBIGINT[], lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END) FROM range(256) t(n)),
        crc AS (SELECT list(x ORDER BY n) AS t FROM bits),
        h AS (SELECT c, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, 1 + length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i, 1))::UBIGINT), lambda r, b: xor(t[(xor(r, b) & 255)::INT + 1], r >> 8)), 4294967295::UBIGINT) % 4 AS h
              FROM (SELECT DISTINCT c FROM o), crc),
        r AS (SELECT h.c, o.d, turn, words FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.d <= h.h UNION ALL SELECT c, d, turn, words FROM o JOIN h USING (c) WHERE d > h),
        q AS (SELECT c, row_number() OVER w AS d, words, string_agg(md5(turn), '') OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY d)),
        p AS (SELECT c, d, words, md5(k) AS k FROM q UNION ALL SELECT c, 0, 0, '' FROM h),
        last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
        n AS (SELECT k, p.d, min(p.c) AS conv, count(*) AS n_convs, any_value(words) AS words,
                     sha256(coalesce(string_agg(CASE WHEN l.d = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends FROM p JOIN last l USING (c) GROUP BY k, p.d),
        up AS (SELECT n.k, n.d, q.k AS parent FROM n LEFT JOIN p q ON q.c = n.conv AND q.d = n.d - 1),
        kids AS (SELECT parent AS k, count(*) AS kids FROM up WHERE parent IS NOT NULL GROUP BY parent),
        own AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
        below AS (SELECT a.k, sum((own.kids = 0)::BIGINT) AS leaves, sum((own.n_convs - 1) * own.words) AS saved FROM own JOIN p a ON a.c = own.conv AND a.d <= own.d GROUP BY a.k)
        SELECT own.conv AS conv_id, own.d::BIGINT AS depth, f.conv AS parent_conv_id, own.n_convs, own.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, own.ends AS ends_sha256
        FROM own JOIN up USING (k) JOIN below USING (k) LEFT JOIN n f ON f.k = up.parent""",
    "op12_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        s AS (SELECT count(*)::BIGINT AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
        f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
        m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts)::BIGINT * N) // L AS m FROM d, s WHERE len(ts) > 0),
        x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM x JOIN m USING (r) WHERE score > 0)
        WHERE rank <= 50""",
    "op13_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
        f AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS least FROM s GROUP BY k HAVING count(*) > 1),
        x AS (SELECT r, i FROM s JOIN f USING (k) WHERE least < coalesce(doc_id, 9223372036854775807)),
        g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM x),
        c AS (SELECT r, count(*) AS n FROM g GROUP BY r),
        u AS (SELECT r, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE r IN (SELECT r FROM c))),
        t AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g USING (r, i) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
}
