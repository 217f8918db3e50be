"""DuckDB SQL that gives the rows of the queries, written independently of the DataFrame code."""

from __future__ import annotations

from martline.llm import quality, secrets, spotsigs, urlfilter

_WORD = "[^\\x20\\x09-\\x0D]+"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quality_ctes(docs: str = "documents", risk: float = quality.RISK, error: float = quality.ERROR) -> str:
    """CTEs up to ``judged``: every row of ``docs`` with its measures and verdict."""
    rules = quality.RULES
    fires = " OR ".join(f"coalesce(1000 * {a} > cut_{r} * {b}, false)" for r, (a, b) in rules.items())
    counts = " UNION ALL ".join(f"SELECT s, '{r}' AS rule, {c} AS cutoff, count(*) FILTER (tune AND 1000 * {a} > {c} * {b}) AS k FROM good GROUP BY s" for r, (a, b) in rules.items() for c in quality.CUTOFFS)
    rungs = ", ".join(f"({j}, {share}, {times})" for j, (share, times) in enumerate(quality.LEVELS))
    return f"""
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS t FROM {docs}),
    f AS (SELECT r, doc_id, s, regexp_extract_all(t, '{_WORD}') AS w, length(translate(t, {_WS}, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
        length(t) - length(translate(t, '!?', '')) AS n_exclaims, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) >= 8)),
    dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, count(DISTINCT i + o) AS n FROM dup, range(8) AS x(o) GROUP BY r),
    m AS (SELECT f.r, doc_id, s, len(w)::BIGINT AS n_words, word_chars, n_symbols, n_capitals, n_exclaims, len(l)::BIGINT AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM f LEFT JOIN cov USING (r)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
    good AS (SELECT *, substr(md5(doc_id::VARCHAR), 1, 1) IN {quality.PROPOSE!r} AS tune FROM b
        WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
    proposing AS (SELECT s, count(*) FILTER (tune) AS tuned FROM good GROUP BY s),
    counts AS ({counts}),
    least AS (SELECT s, rule, level, times, min(cutoff) FILTER (1000 * k <= share * tuned) AS least FROM counts JOIN proposing USING (s), (VALUES {rungs}) AS x(level, share, times) GROUP BY ALL),
    rung AS (SELECT s, level, {", ".join(f"min(cut) FILTER (rule = '{r}') AS cut_{r}" for r in rules)} FROM (SELECT s, rule, level, (SELECT min(c) FROM unnest({list(quality.CUTOFFS)}) AS y(c) WHERE c >= times * least) AS cut FROM least) GROUP BY s, level),
    held AS (SELECT s, level, count(*) AS n, count(*) FILTER ({fires}) AS k FROM good JOIN rung USING (s) WHERE NOT tune GROUP BY s, level),
    tested AS (SELECT s, level, (CASE WHEN k >= n * {risk!r} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))
        FROM unnest(range(0, k + 1)) AS x(i)) END) <= {error!r} / (SELECT count(DISTINCT s) FROM held) AS passed FROM held),
    safe AS (SELECT s, max(level) AS level FROM tested t WHERE NOT EXISTS (SELECT 1 FROM tested u WHERE u.s = t.s AND u.level <= t.level AND NOT u.passed) GROUP BY s),
    cuts AS (SELECT rung.* FROM rung JOIN safe USING (s, level)),
    judged AS (SELECT b.*, NOT base_failed AND NOT ({fires}) AS kept FROM b LEFT JOIN cuts USING (s))"""


OP1 = f"""WITH {quality_ctes()}
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged"""


def mixing_ctes(docs: str = "documents") -> str:
    """CTEs up to ``mixed``: every row of ``docs`` with its source's target and its copies."""
    return f"""
    z AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM {docs}),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
    s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS w, 2 * source_size AS cap, sum(source_size) OVER () AS everything FROM s0),
    s2 AS (SELECT a.*, (SELECT coalesce(sum(b.cap), 0) FROM s1 b WHERE b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND coalesce(b.source < a.source, a.source IS NULL AND b.source IS NOT NULL, false))) AS full_before,
        (SELECT coalesce(sum(b.w), 0) FROM s1 b WHERE b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND coalesce(b.source < a.source, a.source IS NULL AND b.source IS NOT NULL, false))) AS w_before, (SELECT sum(w) FROM s1) AS w_all FROM s1 a),
    s3 AS (SELECT *, (1.5::DOUBLE * everything::DOUBLE - full_before::DOUBLE) / (w_all - w_before)::DOUBLE AS level FROM s2),
    s4 AS (SELECT *, w * level < cap AS open FROM s3),
    s5 AS (SELECT source, source_size, CASE WHEN open THEN w * (SELECT level FROM s4 WHERE open ORDER BY cap / w, source ASC NULLS LAST LIMIT 1) ELSE cap::DOUBLE END AS target FROM s4),
    z1 AS (SELECT z.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source),
    z2 AS (SELECT *, floor(e)::BIGINT AS certain, CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) * ((1 - (e - floor(e))) / (e - floor(e))) END AS q FROM z1),
    z3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, target - sum(certain * size) OVER (PARTITION BY source) AS wanted FROM z2),
    mixed AS (SELECT *, certain + (q IS NOT NULL AND upto - size / 2 <= wanted)::BIGINT AS copies FROM z3)"""


OP6 = f"""WITH {mixing_ctes()}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str) -> str:
    """(r, kind, start, end, match) of the matches: the lengths of matches and of what lies between them, summed in order."""
    return f"""SELECT r, '{kind}' AS kind, sum(length(gap) + length(match)) OVER (PARTITION BY r ORDER BY i) - length(match) AS start,
        sum(length(gap) + length(match)) OVER (PARTITION BY r ORDER BY i) AS stop, match
        FROM (SELECT r, unnest(regexp_split_to_array(t, {_q(pattern)})[1:len(regexp_extract_all(t, {_q(pattern)}))]) AS gap, unnest(regexp_extract_all(t, {_q(pattern)})) AS match,
            unnest(range(len(regexp_extract_all(t, {_q(pattern)})))) AS i FROM d WHERE regexp_matches(t, {_q(pattern)}))"""


OP9 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    base AS (SELECT * FROM ({_spans("assign", secrets.ASSIGN)}) WHERE length(regexp_replace(match, {_q("^" + secrets.ASSIGN_HEAD)}, '')) >= 6
        UNION ALL {_spans("access", secrets.ACCESS)} UNION ALL {_spans("hex", secrets.HEX)}),
    run AS (SELECT row_number() OVER () AS n, * FROM ({_spans("random", secrets.RUN)}) WHERE regexp_matches(match, {_q(secrets.TOLD)})),
    sample AS (SELECT 'r' AS label, s FROM (SELECT DISTINCT CASE kind WHEN 'assign' THEN regexp_replace(match, {_q("^" + secrets.ASSIGN_HEAD)}, '') ELSE match END AS s FROM base) WHERE length(s) > 1),
    plain AS (SELECT 'o' AS label, s FROM (SELECT DISTINCT unnest(regexp_split_to_array(regexp_replace(t, {_q("|".join((secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.RUN)))}, ' ', 'g'), '[^A-Za-z0-9_]+')) AS s FROM d) WHERE length(s) >= 6),
    two AS (SELECT label, substr(s, i, 1) AS a, substr(s, i + 1, 1) AS b FROM (SELECT label, s, unnest(range(1, length(s))) AS i FROM (FROM sample UNION ALL FROM plain))),
    seen AS (SELECT instr('{secrets.ALPHABET}', a) * 63 + instr('{secrets.ALPHABET}', b) AS pair, count(*) FILTER (label = 'r') AS rn, count(*) FILTER (label = 'o') AS o FROM two GROUP BY 1),
    counts AS (SELECT p AS pair, p // 63 AS first, coalesce(rn, 0) AS rn, coalesce(o, 0) AS o FROM range(63 * 63) AS x(p) LEFT JOIN seen ON p = pair),
    totals AS (SELECT *, sum(rn) OVER (PARTITION BY first) AS rs, sum(o) OVER (PARTITION BY first) AS os, sum(rn) OVER () > 0 AND sum(o) OVER () > 0 AS told FROM counts),
    model AS (SELECT pair, CASE WHEN told AND first > 0 AND pair % 63 > 0 THEN round(1000 * (ln({1 - secrets.MIXED[0]!r} * (CASE WHEN rs > 0 THEN rn / rs ELSE 1.0 / 63 END)::DOUBLE + {secrets.MIXED[0] / 63!r}::DOUBLE)
        - ln({1 - secrets.MIXED[1]!r}::DOUBLE * (CASE WHEN os > 0 THEN o / os ELSE 1.0 / 63 END)::DOUBLE + {secrets.MIXED[1] / 63!r}::DOUBLE))) ELSE 0 END AS weight FROM totals),
    piece AS (SELECT n AS r, start, stop, match FROM ({_spans("random", secrets.STRETCH).replace("FROM d WHERE", "FROM (SELECT n AS r, match AS t FROM run) WHERE")}) AS x(n, kind, start, stop, match)),
    part AS (SELECT n, true AS whole, r, start, stop, match FROM run UNION ALL SELECT n, false, run.r, run.start + piece.start, run.start + piece.stop, piece.match FROM piece JOIN run ON run.n = piece.r),
    free AS (SELECT * FROM part WHERE length(match) >= {secrets.LEAST} AND regexp_matches(match, {_q(secrets.TOLD)}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = part.r AND b.start < part.stop AND part.start < b.stop)),
    judged AS (SELECT n, whole, r, start, stop, match, sum(weight) AS llr FROM (SELECT *, unnest(range(1, length(match))) AS i FROM free)
        JOIN model ON pair = instr('{secrets.ALPHABET}', substr(match, i, 1)) * 63 + instr('{secrets.ALPHABET}', substr(match, i + 1, 1)) GROUP BY ALL HAVING sum(weight) > {secrets.LIMIT} * length(match)),
    scored AS (SELECT * FROM judged WHERE whole OR n NOT IN (SELECT n FROM judged WHERE whole)),
    ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'random'], kind) AS k FROM (SELECT r, kind, start, stop FROM base UNION ALL SELECT r, 'random', start, stop FROM scored)),
    told AS (SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM ranked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""


def _sigs(table: str, text: str) -> str:
    """(r, s): the set of signatures of each text."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    stop = "[" + ", ".join(_q(w) for w in spotsigs.ANCHORS) + "]"
    spots = f"""list_sort(list_distinct(list_transform(list_filter(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({stop}, w[i])),
        lambda i: list_concat([w[i]], list_filter(w[i + 1:i + {spotsigs.SPAN}], lambda y: NOT list_contains({stop}, y))[1:{spotsigs.CHAIN}])), lambda l: len(l) = {spotsigs.CHAIN + 1}), lambda l: array_to_string(l, ' '))))"""
    return f"""SELECT r, CASE WHEN len(s) > 0 THEN s WHEN t = '' THEN [] WHEN len(w) > 1 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: '= ' || w[i] || ' ' || w[i + 1]))) ELSE ['=' || md5(t)] END AS s
        FROM (SELECT r, t, w, {spots} AS s FROM (SELECT r, {text} AS t, {words} AS w FROM {table}))"""


def _like(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN (len({a}) = len({b}))::INT::DOUBLE ELSE {common} / (len({a}) + len({b}) - {common}) END"


OP2 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, r % count(*) OVER () + 1 AS following FROM d),
    e AS (SELECT n.r, n.doc_id, n.text, n.following, left(n.text, length(n.text) - length(n.text) // 3) || left(f.text, length(n.text) // 3) AS edited FROM n JOIN d f ON f.r = n.following),
    a AS ({_sigs("d", "text")}), b AS ({_sigs("e", "edited")}),
    k AS (SELECT min(r) AS i, min(doc_id) AS least, s FROM a JOIN d USING (r) GROUP BY s),
    g AS (SELECT i, len(s) AS n, unnest(s) AS x FROM k),
    l AS (SELECT g.i, h.i AS j FROM g JOIN g h ON g.x = h.x AND g.i <> h.i GROUP BY g.i, h.i, g.n, h.n HAVING 100 * count(*) >= 80 * (g.n + h.n - count(*))),
    c AS (SELECT i, i AS j FROM k UNION SELECT c.i, l.j FROM c JOIN l ON l.i = c.j),
    m AS (SELECT c.i, min(k.least) AS class_id FROM c JOIN k ON k.i = c.j GROUP BY c.i),
    o AS (SELECT r, class_id FROM a JOIN k USING (s) JOIN m USING (i))
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, len(a.s) || ':' || sha256(array_to_string(a.s, chr(10))) AS fingerprint, len(b.s) || ':' || sha256(array_to_string(b.s, chr(10))) AS edited_fingerprint,
    {_like("a.s", "b.s")} AS near_edited, {_like("a.s", "f.s")} AS near_next, class_id FROM e JOIN a USING (r) JOIN o USING (r) JOIN b USING (r) JOIN a f ON f.r = e.following"""


_CTRL = "/?s>|/?INST\\]|/?ROLE[ \\]]"
OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, length(regexp_replace(text, '([<\\[])(\\\\*)({_CTRL})', '\\1\\2#\\3', 'g')) AS n, length(regexp_replace(regexp_replace(role, '([<\\[])(\\\\*)({_CTRL})', '\\1\\2\\\\\\3', 'g'), '[\\\\\\]]', '##', 'g')) AS rn FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + rn END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " + "'{0}'" .format(f"{v} {h}{p}") for v, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2])))
OP7 = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    f AS (SELECT *, CASE {_FITS} END AS fit FROM u)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN len(list_intersect(string_split(host, '.'), {list(urlfilter.LISTED)!r})) > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f"""


def _linked(sets: str, percent: int = 80) -> str:
    """CTEs up to ``links`` (a, b): the pairs of ``sets`` (r, e: distinct elements) whose coefficient is percent / 100 or more.
    Candidates share one of the rarest n - ceil(n * percent / 100) + 1 elements of either."""
    return f"""
    df AS MATERIALIZED (SELECT e, count(*) AS df FROM {sets} GROUP BY e), n AS MATERIALIZED (SELECT r, count(*) AS n FROM {sets} GROUP BY r),
    ranked AS (SELECT r, e, n, row_number() OVER (PARTITION BY r ORDER BY df, e) AS k FROM {sets} JOIN df USING (e) JOIN n USING (r)),
    head AS MATERIALIZED (SELECT r, e, n FROM ranked WHERE k <= n - ({percent} * n + 99) // 100 + 1),
    pairs AS MATERIALIZED (SELECT DISTINCT a.r AS a, b.r AS b, a.n AS na, b.n AS nb FROM head a JOIN head b ON a.e = b.e AND a.r < b.r AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN {sets} x ON x.r = a JOIN {sets} y ON y.r = b AND y.e = x.e GROUP BY a, b, na, nb HAVING 100 * count(*) >= {percent} * (na + nb - count(*))),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
    s AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS e FROM d),{_linked('s')},
    least_of AS (SELECT a, min(doc_id) AS least FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, least) AS component_id, doc_id = least(doc_id, least) AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN least_of ON a = r"""

#: CRC-32 of a list of bytes, by its table.
_CRC = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""
_CRC_OF = "xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"

OP13 = f"""WITH RECURSIVE {_CRC},
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
    found AS (SELECT id, w, count(*) AS c FROM runs WHERE length(w) >= 6 GROUP BY id, w),
    coded AS (SELECT w, c, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM found),
    hashed AS (SELECT w, c, {_CRC_OF} AS h FROM coded, crc_table),
    edited AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
    v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    shorter AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS x FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
        UNION SELECT v.word, d.word, d.n FROM v JOIN shorter d ON d.x = v.word UNION SELECT d.word, v.word, v.n FROM v JOIN shorter d ON d.x = v.word),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
    formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS reached, 0 AS k FROM formed UNION ALL SELECT walk.word, formed.form, k + 1 FROM walk JOIN formed ON formed.word = walk.reached WHERE formed.form IS NOT NULL),
    ends AS (SELECT word, max_by(reached, k) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

# Lines with a word, by their first place; equal lines are one. Of each component the first line stays.
OP3 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, xxh, text) AS r, doc_id, text FROM (SELECT *, hash(text) AS xxh FROM documents)),
    cut AS MATERIALIZED (SELECT r AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line FROM d),
    worded AS MATERIALIZED (SELECT *, regexp_matches(line, '{_WORD}') AS has FROM cut),
    firsts AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY doc, place) AS r, doc, place FROM (SELECT line, min(doc) AS doc, arg_min(place, doc * 100000000 + place) AS place FROM worded WHERE has GROUP BY line)),
    s AS MATERIALIZED (SELECT r, unnest(list_distinct(list_transform(range(1, greatest(length(line) - 7, 1) + 1), lambda i: substr(line, i::INT, 8)))) AS e FROM firsts),{_linked('s')},
    gone AS (SELECT DISTINCT a AS r FROM reach WHERE b < a),
    stays AS (SELECT doc, place FROM firsts WHERE r NOT IN (SELECT r FROM gone)),
    told AS (SELECT w.doc, w.place, w.line, w.has, NOT w.has OR stays.doc IS NOT NULL AS kept FROM worded w LEFT JOIN stays ON stays.doc = w.doc AND stays.place = w.place),
    whole AS (SELECT doc, count(*) FILTER (has) AS n_lines, count(*) FILTER (has AND kept) AS n_kept, string_agg(line, chr(10) ORDER BY place) FILTER (kept) AS text FROM told GROUP BY doc)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN d.text IS NOT NULL THEN coalesce(whole.text, '') END AS text FROM d LEFT JOIN whole ON doc = r"""
