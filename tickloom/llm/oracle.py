"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from tickloom.llm.quality_rules import STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x20\x09-\x0D]+"


def _item_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_GAP}'), lambda x: x <> '')"


def decontamination(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_item_words("text")} AS w FROM {docs}),
b AS (SELECT item_id, {_item_words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""


def quality_rules() -> str:
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_words("text")} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS l FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS stops, len(l) AS lines,
             len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS dots
      FROM d LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             coalesce(word_chars / nullif(n_words, 0) BETWEEN 1.5 AND 20, true) AND coalesce(n_symbols / nullif(n_words, 0) <= 0.1, true)
             AND coalesce(bangs / nullif(n_words, 0) <= 0.3, true) AND coalesce(stops / nullif(n_words, 0) >= 0.02, true)
             AND coalesce(n_dup_lines / nullif(lines, 0) <= 0.6, true) AND coalesce(dots / nullif(lines, 0) <= 0.5, true) AS fine FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM f"""


def mix_ctes(docs: str, seed: str = "mix") -> str:
    """CTEs ending in `mixed`: every row of `docs` with size, source_size, target and copies."""
    return f"""
base AS (SELECT *, CAST(len({_words("text")}) AS BIGINT) AS size,
                md5(concat_ws(':', '{seed}', coalesce(md5(CAST(doc_id AS VARCHAR)), ''), coalesce(md5(text), ''))) AS o FROM {docs}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
leveled AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0::DOUBLE)) AS level
            FROM weighted WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, cap / weight) AS final FROM leveled WHERE level <= cap / weight),
targets AS (SELECT source, source_size, least(cap, coalesce(weight * final, cap)) AS target FROM weighted LEFT JOIN level ON true),
queued AS (SELECT b.*, source_size, target, copy,
                  copy * source_size + sum(size) OVER (PARTITION BY b.source, copy ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
           FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS copy)),
cut AS (SELECT *, sum(size) OVER (ORDER BY CAST(upto AS DOUBLE) / nullif(target, 0), source NULLS LAST, copy, o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  <= (SELECT 1.5::DOUBLE * sum(size) FROM base) AS taken FROM queued),
mixed AS (SELECT doc_id, text, lang, source, n_chars, size, source_size, target, o, count(*) FILTER (WHERE taken) AS copies FROM cut GROUP BY ALL)"""


def mixing() -> str:
    return f"WITH {mix_ctes('documents')} SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"


def warc_audit() -> str:
    number, end = "coalesce(CAST(page_id AS VARCHAR), '')", "chr(13) || chr(10)"
    flat = r"regexp_replace(url, '[\r\n]+', ' ', 'g')"
    return f"""
WITH p AS (SELECT page_id, url, {flat} AS u, coalesce(html, '') AS b FROM pages)
SELECT page_id, sha256(b) AS payload_sha256, coalesce(md5(u) < '05', false) AS damaged,
       CAST(strlen(concat_ws({end}, 'WARC/1.1', 'WARC-Type: resource', 'WARC-Record-ID: <urn:x-page:' || md5(concat_ws(':', {number}, url)) || '>',
                'WARC-Target-URI: ' || u, 'WARC-Date: 2024-01-01T00:00:00Z', 'Content-Type: text/html', 'X-Page-Id: ' || {number},
                'WARC-Payload-Digest: sha256:' || sha256(b), 'Content-Length: ' || strlen(b), '', b, '', '')) AS BIGINT) AS record_bytes
FROM p"""


def fill_in_middle() -> str:
    return r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT *, [CAST('0x' || d[i * 8 + 1:i * 8 + 8] AS BIGINT) for i in [0, 1, 2, 3]] AS h FROM t),
c AS (SELECT doc_id, x, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS z,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:z], ''), '') AS mid, coalesce(array_to_string(w[z + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars, sha256(x) AS restored_sha256,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256
FROM p"""


def phrases(least: int = 10, percent: int = 50, top: int = 2000) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, array_to_string(w[i:i], ' ') AS first, array_to_string(w[i + m - 1:i + m - 1], ' ') AS last,
                 array_to_string(w[i + 1:i + m - 1], ' ') AS tail, array_to_string(w[i:i + m - 2], ' ') AS head
          FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, any_value(first) AS first, any_value(last) AS last, any_value(tail) AS tail, any_value(head) AS head, count(*) AS a FROM grams GROUP BY lang, m, g),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {least}),
cuts AS (SELECT c.lang, c.g, c.m, c.a, 1 AS k, x.a AS l, y.a AS r FROM c JOIN f x ON x.lang = c.lang AND x.m = 1 AND x.g = c.first JOIN f y ON y.lang = c.lang AND y.m = c.m - 1 AND y.g = c.tail
         UNION ALL
         SELECT c.lang, c.g, c.m, c.a, 2, x.a, y.a FROM c JOIN f x ON x.lang = c.lang AND x.m = 2 AND x.g = c.head JOIN f y ON y.lang = c.lang AND y.m = 1 AND y.g = c.last WHERE c.m = 3),
scored AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g, m ORDER BY score, k) = 1),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, head AS g, a FROM c WHERE m = 3 UNION ALL SELECT lang, tail, a FROM c WHERE m = 3) GROUP BY lang, g),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON s.m = 2 AND s.lang = i.lang AND s.g = i.g WHERE longer IS NULL OR 100 * longer < {percent} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {top}"""


SQL = {"op12_phrases": phrases(), "op13_fill_in_middle": fill_in_middle(), "op5_warc_audit": warc_audit(), "op1_decontamination": decontamination(), "op3_quality_rules": quality_rules(), "op9_mixing": mixing()}
