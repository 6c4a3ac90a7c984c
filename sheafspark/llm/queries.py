"""The operators over their tables, as registered queries, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheafspark.llm import arc, convrepair, fmindex, langid, lengths, mincut, mixing, quality, records, rules, simhash, urlrules, veccodes
from sheafspark.llm.storage import stage

END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_file() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces_file() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(table(spark, sf_dir, "pages"))


def op3_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return fmindex.report(found)


def op4_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read_back(table(spark, sf_dir, "documents"), words_file(), END_ID)


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(rules.ledger(table(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version costs, from one ledger of all documents."""
    return rules.all_ablations(stage(rules.ledger(table(spark, sf_dir, "documents"))))


def op9_marginal_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(table(spark, sf_dir, "documents"), pieces_file())


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_counts(table(spark, sf_dir, "documents"), words_file()))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_conversations(convrepair.damage(table(spark, sf_dir, "conversations")))


def op13_dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(table(spark, sf_dir, "embeddings"))


# The ledger of all rules; kept apart because the ablations are sums over it.
_LEDGER = r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS phrase
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, phrase) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
        m AS (SELECT l.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words,
                     CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(len(lines) AS BIGINT) AS n_lines,
                     CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS BIGINT) AS n_letter_words,
                     CAST(len(regexp_extract_all(text, '@UNSPACED@')) AS BIGINT) AS n_unspaced
              FROM l LEFT JOIN c ON l.doc_id = c.doc_id),
        f AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END
                     + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
                     + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
                     + CASE WHEN 100 * n_letter_words < 60 * n_words THEN 32 ELSE 0 END
                     + CASE WHEN word_chars < 2 * n_words OR word_chars - n_unspaced > 20 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
""".replace("@UNSPACED@", rules.UNSPACED)


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All distances to all entries, round by round."""
    near = """
        n{i} AS MATERIALIZED (
            SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS best FROM (
                SELECT vec_id, v.part AS part, entry, sum((v.x - b.x) * (v.x - b.x)) AS d
                FROM v JOIN b{i} AS b ON v.part = b.part AND v.pos = b.pos GROUP BY vec_id, v.part, entry)
            GROUP BY vec_id, part)"""
    renew = """
        b{j} AS MATERIALIZED (
            SELECT b.part AS part, b.entry AS entry, b.pos AS pos, coalesce(m.x, b.x) AS x FROM b{i} AS b LEFT JOIN (
                SELECT v.part AS part, n.best.entry AS entry, pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x
                FROM v JOIN n{i} AS n ON v.vec_id = n.vec_id AND v.part = n.part GROUP BY v.part, n.best.entry, pos) AS m
            ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""
    steps = []
    for i in range(rounds):
        steps += [near.format(i=i), renew.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return f"""
        WITH k AS (SELECT vec_id, label, embedding FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (
            SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(CAST(embedding[i] AS DOUBLE) * 4096) AS BIGINT) AS x
            FROM (SELECT vec_id, embedding, len(embedding) // {parts} AS w, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
        b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM v JOIN f ON v.vec_id = f.vec_id),
        {",".join(steps)},
        c AS (SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
              FROM n{rounds} GROUP BY vec_id)
        SELECT c.vec_id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM c JOIN k ON c.vec_id = k.vec_id
    """


def _repair_sql() -> str:
    """The cheapest edits row by row: per conversation and state the least (cost, audit, repaired lines)."""

    def after(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"

    def least(*entries: str) -> str:
        return f"list_min([{', '.join(entries)}])"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    both = "'user:' || chr(10) || 'assistant:' || chr(10)"
    w2 = least("s2", after("s0", "5", "I", user), after("s1", "5", "I", user), after("s3", "5", "I", user))
    w3 = least("s3", after("s2", "5", "I", assistant), after("s0", "10", "II", both), after("s1", "10", "II", both))

    def kept(state: str, initial: str, role: str) -> list[str]:
        keep = f"CASE WHEN go OR initial <> '{initial}' THEN 1000000000 ELSE 5 * cut END"
        found = [after(state, keep, "K", "role || ':' || text || chr(10)")]
        if role:
            anew = "CASE WHEN go THEN 1000000000 ELSE 1 + 5 * cut END"
            found.append(after(state, anew, "R", f"'{role}:' || text || chr(10)"))
        return found

    n0 = after("s0", "2", "D")
    n1 = least(after("s1", "2", "D"), *kept("s0", "s", ""))
    n2 = least(after("w2", "2", "D"), *kept("s0", "u", "user"), *kept("s1", "u", "user"), *kept("w3", "u", "user"))
    n3 = least(after("w3", "2", "D"), *kept("w2", "a", "assistant"))
    none = "{'c': 1000000000, 'a': '', 't': ''}"
    return rf"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(
                       list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                      lambda x: CAST(ascii(x) AS BIGINT)),
                       lambda acc, b: list_reduce(CAST(range(8) AS BIGINT[]),
                           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b)),
                       4294967295), 4294967295) % 20 AS kind FROM conversations),
        d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
            FROM k WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i,
                     rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
        e AS (SELECT *, body = '' AS blank, substr(role, 1, 1) AS initial,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                     lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS step FROM o),
        f AS (SELECT *, blank OR seen AS go, CASE WHEN NOT blank AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM e),
        m AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, sum(cut) AS truncated,
                     count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        r AS (
            SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, {n0}, {n1}, {n2}, {n3}
            FROM (SELECT f.conv_id, f.i, role, text, initial, go, cut, s0, s1, s3, {w2} AS w2, {w3} AS w3
                  FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1)),
        z AS (SELECT r.conv_id AS conv_id, m.* EXCLUDE (conv_id), {least("s0", w3)} AS best
              FROM r LEFT JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id WHERE r.i = coalesce(m.n, 0))
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
               sha256(CASE WHEN best.t = '' THEN '' ELSE substr(best.t, 1, length(best.t) - 1) END) AS repaired_sha256
        FROM z
    """


QUERIES = {
    f.__name__: f
    for f in (
        op1_arc_to_warc,
        op2_min_cut_text,
        op3_fm_index_decontamination,
        op4_splitting_tree_mix,
        op5_binary_records,
        op6_ftrl_quality,
        op7_covering_simhash,
        op8_rule_ledger,
        op9_marginal_language_id,
        op10_length_histogram,
        op11_url_rules,
        op12_conversation_repair,
        op13_dictionary_codes,
        rule_ablations,
    )
}

SQL = {
    "op1_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM m
    """,
    "op3_fm_index_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        k AS (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
               FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
               FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM k))),
        hits AS (SELECT doc_id, item_id, i, dw.k AS k FROM dw JOIN bw ON dw.k = bw.k AND dw.phrase = bw.phrase),
        covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op8_rule_ledger": _LEDGER + "SELECT *, failed & 3 <> 0 AS base_failed, failed & 111 = 0 AS kept FROM f",
    "rule_ablations": _LEDGER
    + """SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only,
        count(*) FILTER (failed & mask = 0) AS kept
        FROM f, (VALUES ('base', 'few_words', 1, 3), ('base', 'repeated_windows', 2, 3),
                 ('v1', 'few_words', 1, 63), ('v1', 'repeated_windows', 2, 63), ('v1', 'many_symbols', 4, 63), ('v1', 'repeated_lines', 8, 63),
                 ('v1', 'word_length', 16, 63), ('v1', 'few_letters', 32, 63),
                 ('v2', 'few_words', 1, 111), ('v2', 'repeated_windows', 2, 111), ('v2', 'many_symbols', 4, 111), ('v2', 'repeated_lines', 8, 111),
                 ('v2', 'few_letters', 32, 111), ('v2', 'spaced_word_length', 64, 111)) AS p(policy, rule, bit, mask)
        GROUP BY policy, rule""",
    "op11_url_rules": r"""
        WITH p AS (SELECT page_id, url, row_number() OVER () AS rn,
                          CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r AS (SELECT *, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM h),
        g AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given,
                     list_reverse(string_split(host, '.')) AS labels,
                     regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM r),
        t AS (SELECT *, CASE WHEN instr(url, '://') = 0 THEN [] ELSE list_sort(list_distinct(
                  ['p:' || translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]
                  || list_transform(list_filter(range(1, len(labels) + 1), lambda i: labels[i] <> ''), lambda i: 'h' || i || ':' || labels[i])
                  || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 's:' || regexp_replace(x, '[0-9]+', '#', 'g'))
                  || list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''),
                                    lambda x: 'q:' || regexp_replace(x, '[0-9]+', '#', 'g'))
                  || CASE WHEN contains(rest, '#') THEN ['f:'] ELSE [] END)) END AS tokens FROM g),
        s AS (SELECT given, rule, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items
              FROM (SELECT given, rule, tokens, unnest(range(1, 1 << len(tokens))) AS m FROM t WHERE given IS NOT NULL)),
        c AS (SELECT items, given, count(*) AS nv, min(rule) < max(rule) AS several FROM s GROUP BY ALL),
        w AS (SELECT *, nv / sum(nv) OVER (PARTITION BY items) AS conf FROM c),
        k AS (SELECT * FROM w WHERE conf >= 0.75 AND several AND nv >= ceil((SELECT count(*) FROM t WHERE given IS NOT NULL) / 128)),
        u AS (SELECT * FROM k WHERE NOT EXISTS (
                SELECT 1 FROM k AS l WHERE l.given = k.given AND len(l.items) = len(k.items) - 1 AND len(l.items) > 0
                AND list_has_all(k.items, l.items) AND l.conf >= k.conf)),
        f AS (SELECT rn, min({'d': -conf, 'f': -nv, 's': -len(items), 'pattern': array_to_string(items, ' '), 'verdict': u.given}) AS best
              FROM t JOIN u ON t.given IS NULL AND list_has_all(t.tokens, u.items) GROUP BY rn)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               coalesce(given, best.verdict, 'allow') AS verdict, best.pattern AS pattern
        FROM t LEFT JOIN f ON t.rn = f.rn
    """,
    "op12_conversation_repair": _repair_sql(),
    "op13_dictionary_codes": _codes_sql(),
}
