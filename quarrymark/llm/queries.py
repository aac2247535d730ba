"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymark.llm import (
    decontamination,
    histogram_sort,
    mixing,
    pii_anchors,
    quality_rules,
    quotation,
    simhash,
    stratified_search,
    template_html,
    trigram_secrets,
    turn_repair,
    vector_graph,
    warc_bundles,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.digests(_table(spark, sf_dir, "pages"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.manifest(_table(spark, sf_dir, "documents"))


def op3_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.digests(_table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.conversations_in_reply_order(_table(spark, sf_dir, "conversations"))


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigram_secrets.digests(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op9_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extracted(_table(spark, sf_dir, "pages"))


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_table(spark, sf_dir, "documents"))


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.digests(_table(spark, sf_dir, "embeddings"))


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_search.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_histogram_sort": op2_histogram_sort,
    "op3_fm_index_decontamination": op3_fm_index_decontamination,
    "op4_pii_anchors": op4_pii_anchors,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_trigram_secrets": op6_trigram_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_html_templates": op9_html_templates,
    "op10_simhash_pigeonring": op10_simhash_pigeonring,
    "op11_pruned_graph": op11_pruned_graph,
    "op12_stratified_search": op12_stratified_search,
    "op13_turn_repair": op13_turn_repair,
}

SQL: dict[str, str] = {
    "op1_warc_bundles": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), keepers AS (
            SELECT payload_digest, max(page_id) AS keeper
            FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to,
               true AS intact
        FROM payloads LEFT JOIN keepers USING (payload_digest)
    """,
    "op3_fm_index_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), bw AS (
            SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS s
            FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                  FROM (SELECT *, least(len(ws), 10) AS n FROM b) WHERE n > 0)
        ), dw AS (
            SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
                  FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(ws) >= n)
        ), hits AS (
            SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_quotation_linking": r"""
        WITH RECURSIVE m AS (
            SELECT row_number() OVER () AS mid, conv_id, turn, role,
                   string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls
            FROM conversations
        ), raw AS (
            SELECT mid, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM m
        ), body AS (
            SELECT *, length(translate(regexp_extract(raw, '^[ \t]*((?:>[ \t]?)+)', 1), ' ' || chr(9), '')) AS level,
                   regexp_replace(raw, '^[ \t]*((?:>[ \t]?)+)', '') AS body
            FROM raw
        ), near AS (
            SELECT *, lead(level) OVER w AS level1, lead(level, 2) OVER w AS level2, trim(lead(body) OVER w, ' ' || chr(9)) AS body1
            FROM body WINDOW w AS (PARTITION BY mid ORDER BY i)
        ), x AS (
            SELECT *, NOT coalesce((level1 > level OR (body1 = '' AND level2 > level)) AND regexp_matches(body,
                   '(?i)\b(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escreveu|ha scritto)\s*:\s*$'), false) AS stays
            FROM near
        ), stepped AS (
            SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY mid ORDER BY i) THEN 1 ELSE 0 END AS step
            FROM x WHERE stays
        ), numbered AS (
            SELECT *, sum(step) OVER (PARTITION BY mid ORDER BY i) AS run FROM stepped
        ), runs AS (
            SELECT mid, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS text FROM numbered GROUP BY mid, run
        ), pars AS (
            SELECT mid, run, level, unnest(ps) AS text, unnest(range(len(ps))) AS par
            FROM (SELECT *, string_split_regex(text, '\n[ \t]*\n') AS ps FROM runs)
        ), units AS (
            SELECT mid, run, level, -1 AS par, 0 AS kind, text FROM runs
            UNION ALL SELECT mid, run, level, par, 1, text FROM pars
            UNION ALL SELECT mid, run, level, par, 2,
                unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))
                FROM pars
            UNION ALL SELECT mid, run, level, par, 3, unnest(string_split(text, chr(10))) FROM pars
        ), u AS (
            SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), '-') AS c, coalesce(turn, -9223372036854775808) AS t, mid, run, level,
                   par, kind, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain
            FROM units JOIN m USING (mid)
        ), said AS (
            SELECT DISTINCT c, plain, t, mid FROM u WHERE level = 0 AND plain <> ''
        ), found AS (
            SELECT q.mid, q.run, q.level, q.par, q.kind, q.plain, max(struct_pack(t := s.t, mid := s.mid)) AS latest
            FROM u q JOIN said s ON s.c = q.c AND s.plain = q.plain AND s.t < q.t
            WHERE q.level > 0 AND (q.kind < 2 OR (SELECT count(*) FROM said a WHERE a.c = q.c AND a.plain = q.plain) = 1)
            GROUP BY ALL
        ), kept AS (
            SELECT * FROM (SELECT *, min(kind) OVER (PARTITION BY mid, run) AS of_run,
                                  min(kind) OVER (PARTITION BY mid, run, par) AS of_par FROM found)
            WHERE kind = 0 OR (of_run > 0 AND kind = of_par)
        ), p AS (
            SELECT mid, count(*) AS n_linked, max(latest) FILTER (WHERE level = 1) AS parent FROM kept GROUP BY mid
        ), walk AS (
            SELECT mid, mid AS top FROM m
            UNION ALL
            SELECT w.mid, p.parent.mid FROM walk w JOIN p ON p.mid = w.top WHERE p.parent IS NOT NULL
        ), roots AS (
            SELECT w.mid, min_by(w.top, struct_pack(t := coalesce(turn, -9223372036854775808), mid := w.top)) AS root
            FROM walk w JOIN m ON m.mid = w.top GROUP BY w.mid
        )
        SELECT m.conv_id, m.turn, m.role,
               coalesce((SELECT trim(string_agg(raw, chr(10) ORDER BY i), ' ' || chr(9) || chr(10)) FROM x
                         WHERE x.mid = m.mid AND stays AND level = 0), '') AS text,
               (SELECT count(*) FROM x WHERE x.mid = m.mid AND level > 0) AS n_quoted,
               coalesce(n_linked, 0) AS n_linked,
               CASE WHEN p.parent.t > -9223372036854775808 THEN p.parent.t END AS parent_turn, r.turn AS root_turn,
               row_number() OVER (PARTITION BY m.conv_id ORDER BY r.turn NULLS FIRST, r.mid, m.turn NULLS FIRST, m.mid) AS position
        FROM m LEFT JOIN p USING (mid) JOIN roots USING (mid) JOIN m r ON r.mid = roots.root
    """,
    "op7_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
            FROM t
        ), g AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1
        ), r AS (
            SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   len(regexp_extract_all(text, '[!?]')) AS marks,
                   len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                   CASE lang
                   WHEN 'en' THEN len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({en})))
                   WHEN 'de' THEN len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({de})))
                   WHEN 'fr' THEN len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({fr})))
                   WHEN 'es' THEN len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({es}))) END AS stops,
                   len(list_filter(ls, lambda l: regexp_matches(l, '^\s*[-*•]\s'))) AS bullets,
                   len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS ellipses
            FROM w LEFT JOIN r USING (doc_id)
        ), q AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                   CASE WHEN n_words > 0 THEN word_chars / n_words END AS mean_word_length,
                   CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbol_ratio,
                   CASE WHEN n_words > 0 THEN marks / n_words END AS mark_ratio,
                   CASE WHEN n_words > 0 THEN stops / n_words END AS stop_word_ratio,
                   CASE WHEN lines > 0 THEN n_dup_lines / lines END AS dup_line_ratio,
                   CASE WHEN lines > 0 THEN bullets / lines END AS bullet_line_ratio,
                   CASE WHEN lines > 0 THEN ellipses / lines END AS ellipsis_line_ratio,
                   n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
            FROM m
        )
        SELECT *, NOT base_failed AND coalesce(mean_word_length BETWEEN 1.5 AND 30, true)
               AND coalesce(symbol_ratio <= 0.3, true) AND coalesce(mark_ratio <= 0.5, true)
               AND coalesce(stop_word_ratio >= 0.01, true) AND coalesce(dup_line_ratio <= 0.5, true)
               AND coalesce(bullet_line_ratio <= 0.9, true) AND coalesce(ellipsis_line_ratio <= 0.5, true) AS kept
        FROM q
    """.format(**{code: ", ".join(f"'{w}'" for w in words) for code, words in quality_rules.STOP_WORDS.items()}),
    "op12_stratified_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), i AS (
            SELECT item_id, row_number() OVER () AS q, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), s AS (
            SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d WHERE len(ws) > 0
        ), tf AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL
        ), m AS (
            SELECT r, doc_id, 100 - 25 + (25 * len(ws) * n_docs) // n_words AS m FROM d, s WHERE len(ws) > 0
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, s GROUP BY term, n_docs
        ), it AS (
            SELECT q, term, count(*) AS times FROM (SELECT q, unnest(ws) AS term FROM i) GROUP BY ALL
        ), scored AS (
            SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL
        ), ranked AS (
            SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
            FROM scored JOIN m USING (r) WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
    """,
    "op13_turn_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                  lambda c: CAST(unicode(c) AS BIGINT)) AS bytes
            FROM conversations
        ), crcs AS (
            SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc
            FROM (SELECT unnest(range(256)) AS n)
        ), summed AS (
            SELECT conv_id, turn, role, text,
                   xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
            FROM keyed, crcs
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM summed
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
            FROM damaged
        ), judged AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, shown = '' AS blank, shown <> '' AND again AS duplicate,
                   shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM numbered
        ), convs AS (
            SELECT conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN judged USING (conv_id) GROUP BY conv_id
        ), inserts(state, ins, paid, mid, names) AS (
            VALUES (0, '', 0, 0, []), (1, '', 0, 1, []), (2, '', 0, 2, []), (3, '', 0, 3, []),
                   (0, 'I', 5, 2, ['user:']), (1, 'I', 5, 2, ['user:']), (2, 'I', 5, 3, ['assistant:']), (3, 'I', 5, 2, ['user:']),
                   (0, 'II', 10, 3, ['user:', 'assistant:']), (1, 'II', 10, 3, ['user:', 'assistant:'])
        ), keeps(mid, initial, fin) AS (
            VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
        ), names(mid, fin, name) AS (
            VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')
        ), edits AS (
            SELECT initial, must, state, paid + 2 AS price, ins || 'D' AS e, mid AS fin, names, NULL AS wrote
            FROM inserts, (SELECT unnest(['s', 'u', 'a', '']) AS initial), (SELECT unnest([true, false]) AS must)
            UNION ALL
            SELECT initial, false, state, paid, ins || 'K', fin, names, '' FROM inserts JOIN keeps USING (mid)
            UNION ALL
            SELECT initial, false, state, paid + 1, ins || 'R', fin, names, name
            FROM inserts JOIN names USING (mid), (SELECT unnest(['s', 'u', 'a', '']) AS initial)
        ), walk AS (
            SELECT conv_id, 0 AS i, n, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS written FROM convs
            UNION ALL
            SELECT conv_id, i, n, state, cost, audit, written FROM (
                SELECT w.conv_id, w.i + 1 AS i, w.n, e.fin AS state,
                       w.cost + e.price + CASE WHEN j.truncated AND e.wrote IS NOT NULL THEN 5 ELSE 0 END AS cost, w.audit || e.e AS audit,
                       w.written || e.names || CASE WHEN e.wrote IS NULL THEN [] WHEN e.wrote = '' THEN [j.role || ':' || j.text]
                                                    ELSE [e.wrote || ':' || j.text] END AS written
                FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
                JOIN edits e ON e.state = w.state AND e.must = (j.blank OR j.duplicate)
                     AND e.initial = CASE WHEN j.initial IN ('s', 'u', 'a') THEN j.initial ELSE '' END
            ) QUALIFY row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) = 1
        ), ended AS (
            SELECT conv_id, cost + paid AS cost, audit || ins AS audit, written || names AS written
            FROM walk JOIN inserts USING (state) WHERE i = n AND mid IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + paid, audit || ins) = 1
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                   count(*) FILTER (WHERE truncated) AS truncated,
                   count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
               sha256(array_to_string(written, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
