"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import chat, license_scan, quality, variants

_WORD = r"[^\x20\x09-\x0D]+"


def mix_sql(documents: str = "documents") -> str:
    """CTEs ``mix_sized`` and ``mix_rates`` over a relation with the columns of documents."""
    return f"""
mix_sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM {documents}),
mix_totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_sized GROUP BY source),
mix_weights AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM mix_totals),
mix_order AS (SELECT *, row_number() OVER w AS k, sum(weight) OVER () - sum(weight) OVER w + weight AS open,
              sum(source_size) OVER w - source_size AS filled, sum(source_size) OVER () AS whole
              FROM mix_weights WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
mix_level AS (SELECT (3 * whole - 4 * filled)::BIGINT AS num, (2 * open)::DOUBLE AS den, k FROM mix_order
              WHERE 2.0::DOUBLE * source_size > weight * ((3 * whole - 4 * filled)::DOUBLE / (2 * open)::DOUBLE)
              ORDER BY k LIMIT 1),
mix_rates AS (SELECT o.source, o.source_size,
              CASE WHEN l.k IS NULL OR o.k < l.k THEN 2.0::DOUBLE * o.source_size ELSE (o.weight * l.num)::DOUBLE / l.den END AS target
              FROM mix_order o LEFT JOIN mix_level l ON true),
mix_copies AS (SELECT d.*, r.source_size, r.target,
               CASE WHEN r.source_size = 0 THEN 0 ELSE floor(r.target / r.source_size)
               + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                      < r.target / r.source_size - floor(r.target / r.source_size) THEN 1 ELSE 0 END END::BIGINT AS copies
               FROM mix_sized d JOIN mix_rates r ON d.source IS NOT DISTINCT FROM r.source)"""


def line_dedup_sql(documents: str = "documents") -> str:
    """CTE ``line_kept`` (the columns of documents, with ``kept``, ``n_lines``, ``n_dropped``)."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
line_split AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}),
line_rows AS (SELECT DISTINCT doc_id, translate(trim(u.line, {blank}), '{upper}', '{upper.lower()}') AS key
              FROM line_split, unnest(lines) AS u(line)),
line_repeated AS (SELECT key, max(doc_id) AS keeper FROM line_rows WHERE length(key) >= 40
                  GROUP BY key HAVING count(*) >= 5),
line_lost AS (SELECT r.doc_id, list(r.key) AS keys FROM line_rows r JOIN line_repeated k ON r.key = k.key
              WHERE r.doc_id IS DISTINCT FROM k.keeper GROUP BY r.doc_id),
line_left AS (SELECT s.*, CASE WHEN l.keys IS NULL THEN lines ELSE
              list_filter(lines, lambda x: NOT list_contains(l.keys, translate(trim(x, {blank}), '{upper}', '{upper.lower()}'))) END AS left_lines
              FROM line_split s LEFT JOIN line_lost l ON s.doc_id IS NOT DISTINCT FROM l.doc_id),
line_kept AS (SELECT * EXCLUDE (lines, left_lines), len(lines)::BIGINT AS n_lines,
              (len(lines) - len(left_lines))::BIGINT AS n_dropped,
              CASE WHEN len(lines) = len(left_lines) THEN text ELSE array_to_string(left_lines, chr(10)) END AS kept
              FROM line_left)"""


OP4 = f"""WITH {mix_sql()}
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM mix_copies"""

OP8 = f"""WITH {line_dedup_sql()}
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM line_kept"""


def license_sql(documents: str = "documents") -> str:
    """Result of the license scan."""
    t, factor = license_scan.THRESHOLD, (2 - license_scan.THRESHOLD) / license_scan.THRESHOLD
    rows = []
    for name, texts in sorted(license_scan.TEMPLATES.items()):
        for text in texts:
            words = license_scan.template_words(text)
            bigrams = list(dict.fromkeys(zip(words, words[1:], strict=False)))
            pairs = ", ".join(f"'{a} {b}'" for a, b in bigrams)
            rows.append(f"({len(rows)}, '{name}', {len(words) - 1}, {license_scan.least_shared(len(bigrams), t)}, [{pairs}])")
    gap = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
    return rf"""
WITH t(tid, license, n, least, pairs) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}),
p AS (SELECT rid, unnest(string_split(text, chr(10))) AS part FROM d
      UNION ALL SELECT rid, part FROM (SELECT rid, unnest(regexp_split_to_array(text, '{gap}')) AS part FROM d) WHERE contains(part, chr(10))
      UNION ALL SELECT rid, text FROM d WHERE regexp_matches(text, '{gap}')),
w AS (SELECT rid, row_number() OVER () AS pid,
             list_filter(string_split(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
      FROM p WHERE length(part) > 2),
b AS (SELECT rid, pid, len(w) - 1 AS n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
      FROM w WHERE len(w) >= 2),
s AS (SELECT b.rid, b.pid, t.license, 2.0::DOUBLE * len(list_intersect(b.pairs, t.pairs)) / (len(b.pairs) + len(t.pairs)) AS dice
      FROM b JOIN t ON b.n * {factor!r}::DOUBLE >= t.n AND b.n <= t.n * {factor!r}::DOUBLE),
whole AS (SELECT rid, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM d),
bg AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS bs FROM whole WHERE len(w) >= 2),
bi AS (SELECT rid, bs[i + 1] AS pair, i FROM (SELECT rid, bs, unnest(range(len(bs))) AS i FROM bg)),
hit AS (SELECT bi.rid, tp.tid, bi.i, array_agg(bi.i) OVER (PARTITION BY bi.rid, tp.tid ORDER BY bi.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later, tp.least, tp.n
        FROM bi JOIN (SELECT tid, n, least, unnest(pairs) AS pair FROM t) tp USING (pair)),
st AS (SELECT DISTINCT rid, tid, unnest(range(greatest(0, later[least] - n + 1), least_(i, len(bs) - n) + 1)) AS s
       FROM (SELECT hit.*, bg.bs FROM hit JOIN bg USING (rid) WHERE len(later) >= least AND later[least] - i < n)),
win AS (SELECT st.rid, st.tid, t.license, t.pairs, list_distinct(bg.bs[st.s + 1:st.s + t.n]) AS own FROM st JOIN t USING (tid) JOIN bg USING (rid)),
ws AS (SELECT rid, tid, license, max(2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(own) + len(pairs))) AS dice FROM win GROUP BY 1, 2, 3 HAVING dice >= {t}),
m AS (SELECT rid, count(DISTINCT pid) AS n_matches, count(DISTINCT tid) AS n_windows, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
      FROM (SELECT rid, pid, NULL AS tid, license, dice FROM s WHERE dice >= {t} UNION ALL SELECT rid, NULL, tid, license, dice FROM ws) GROUP BY rid)
SELECT d.doc_id, m.license, coalesce(m.dice, 0.0::DOUBLE) AS dice, coalesce(m.n_matches, 0) AS n_matches, coalesce(m.n_windows, 0) AS n_windows
FROM d LEFT JOIN m USING (rid)""".replace("least_(", "least(")


def quality_sql(documents: str = "documents") -> str:
    """Result of the quality rules."""
    q = quality
    classes = ["[^a-z]", "[^A-Z]", r"[^\p{L}]", "[^0-9]", r"""[^.,;:!?()''"-]""", r"[^#*$%&|<>]", r"[^\x20\x09-\x0D]"]
    sizes = ", ".join(f"length(regexp_replace(text, '{c}', '', 'g'))" for c in classes)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i, w FROM w WHERE len(w) > {q.WINDOW}),
txt AS (SELECT rid, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS t FROM win),
rep AS (SELECT rid, unnest(range(i, i + {q.WINDOW})) AS i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM txt) WHERE n > 1),
nrep AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM rep GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
cls AS (SELECT rid, lang, length(text) AS n, [{sizes}] AS c FROM d),
bins AS (SELECT rid, lang, 'class' AS kind, unnest(['az', 'AZ', 'letter', 'digit', 'point', 'symbol', 'blank', 'other']) AS bin,
                unnest([c[1], c[2], c[3] - c[1] - c[2], c[4], c[5], c[6], c[7],
                        n - c[3] - c[4] - c[5] - c[6] - c[7]]) AS x FROM cls),
tok AS (SELECT rid, lang, unnest(w) AS word FROM w),
freq AS (SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k
                                 FROM tok GROUP BY lang, word) WHERE k <= {q.COMMON_WORDS}),
own AS (SELECT t.rid, t.word, count(*) AS x FROM tok t JOIN freq f ON t.word = f.word AND t.lang IS NOT DISTINCT FROM f.lang GROUP BY 1, 2),
common AS (SELECT w.rid, w.lang, f.word AS bin, coalesce(o.x, 0) AS x
           FROM w JOIN freq f ON w.lang IS NOT DISTINCT FROM f.lang LEFT JOIN own o ON o.rid = w.rid AND o.word = f.word
           UNION ALL SELECT w.rid, w.lang, '', len(w.w) - coalesce((SELECT sum(x) FROM own o WHERE o.rid = w.rid), 0) FROM w),
hist AS (SELECT * FROM bins UNION ALL SELECT rid, lang, 'common', bin, x FROM common),
ref AS (SELECT lang, kind, bin, sum(x) AS y FROM hist GROUP BY 1, 2, 3),
both_ AS (SELECT h.rid, h.kind, h.x / nullif(sum(h.x) OVER p, 0) AS a, r.y / nullif(sum(r.y) OVER p, 0) AS b
          FROM hist h JOIN ref r ON r.kind = h.kind AND r.bin = h.bin AND r.lang IS NOT DISTINCT FROM h.lang
          WINDOW p AS (PARTITION BY h.rid, h.kind)),
js AS (SELECT rid, kind, CASE WHEN bool_and(a IS NOT NULL AND b IS NOT NULL) THEN sqrt(greatest(0.0, sum(
         CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2)) END AS dist
       FROM both_ GROUP BY rid, kind),
lim AS (SELECT lang, {q.MAX_COMMON_SHARE!r}::DOUBLE * sqrt(greatest(0.0, sum(CASE WHEN bin <> '' THEN b ELSE log2(2 / (1 + b)) + CASE WHEN b > 0 THEN b * log2(2 * b / (1 + b)) ELSE 0 END END) / 2)) AS common_limit
        FROM (SELECT lang, bin, y / nullif(sum(y) OVER (PARTITION BY lang), 0) AS b FROM ref WHERE kind = 'common') GROUP BY lang),
f AS (SELECT w.rid, w.doc_id, coalesce(lim.common_limit, 0.0) AS common_limit, len(w.w)::BIGINT AS n_words, (cls.n - cls.c[7])::BIGINT AS word_chars, cls.c[6]::BIGINT AS n_symbols,
             coalesce(ln.n_dup_lines, 0) AS n_dup_lines, coalesce(nrep.n_repeat_words, 0) AS n_repeat_words,
             c.dist AS class_distance, m.dist AS common_distance
      FROM w JOIN cls USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN nrep USING (rid)
      LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM w.lang LEFT JOIN (SELECT * FROM js WHERE kind = 'class') c USING (rid) LEFT JOIN (SELECT * FROM js WHERE kind = 'common') m USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
       AND NOT (word_chars >= {q.MIN_CLASS_CHARS} AND coalesce(class_distance, 0) > {q.MAX_CLASS_DISTANCE})
       AND NOT (n_words >= {q.MIN_COMMON_WORDS} AND coalesce(common_distance, 0) > common_limit) AS kept,
       class_distance, common_distance, common_limit FROM f"""


def variants_sql(documents: str = "documents") -> str:
    """Result of the spelling variants: crc32 by a table made from its polynomial, near
    words by the strings that one deletion leaves."""
    v = variants
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    table = f"list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: {step}, i))"
    octets = "list_transform(range(0, length(hex(encode(s))) // 2), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)"
    return rf"""
WITH RECURSIVE poly AS (SELECT {table} AS t),
run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM {documents}),
lowered AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s,
                   translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM run WHERE length(raw) >= {v.MIN_CHARS}),
seen AS (SELECT s, w, count(*) AS n FROM lowered GROUP BY s, w),
hashed AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce({octets}, lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256), 4294967295::BIGINT)) AS h
           FROM seen, poly),
edited AS (SELECT CASE WHEN h % {v.DELETE_EVERY} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {v.MIN_CHARS} GROUP BY word HAVING sum(n) >= {v.MIN_COUNT}),
gone AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS left_over
         FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pair AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.left_over = b.left_over AND a.i = b.i AND a.word <> b.word
         UNION SELECT w.word, g.word, g.n FROM words w JOIN gone g ON g.left_over = w.word
         UNION SELECT g.word, w.word, w.n FROM words w JOIN gone g ON g.left_over = w.word),
near AS (SELECT word, count(*)::BIGINT AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM pair GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {v.RATIO} * w.n THEN best END AS form,
                 CASE WHEN best_n >= {v.RATIO} * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
follow AS (SELECT word, word AS root, form AS next FROM forms
           UNION ALL SELECT follow.word, forms.word, forms.form FROM follow JOIN forms ON follow.next = forms.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN follow r ON f.word = r.word AND r.next IS NULL"""


def chat_sql(conversations: str = "conversations") -> str:
    """Result of the chat formatting; only the length of the formatted text depends on the
    template."""
    def escaped(x: str) -> str:
        return rf"regexp_replace({x}, '{chat.ESCAPE}', '\1\\\2\3', 'g')"

    role = escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
              UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k,
                    length({role}) + length({escaped("text")}) AS chars FROM said),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
                 coalesce(string_agg(CASE WHEN role = '{chat.ASSISTANT}' THEN text END, '' ORDER BY k), '') AS loss,
                 sum(chars + {len(chat.START) + 1 + len(chat.END)})::BIGINT AS formatted_chars FROM numbered GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""


ORACLES = {"op4_mix_sources": OP4, "op5_license_scan": license_sql(), "op7_quality_rules": quality_sql(),
           "op8_line_dedup": OP8, "op11_spelling_variants": variants_sql(), "op13_chat_formatting": chat_sql()}
