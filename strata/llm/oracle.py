r"""DuckDB twins of the training-data queries that SQL can express, written from
the contracts: words and windows are rows, sets and counts are joins."""

from __future__ import annotations

BLANK = r"\x20\x09-\x0D"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(source: str, ident: str, pattern: str, lower: bool) -> str:
    """(id, p, w): the words of each text with their position from 1."""
    text = f"translate(coalesce(text, ''), '{UP}', '{LOW}')" if lower else "coalesce(text, '')"
    return f"""SELECT {ident} AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
               FROM (SELECT {ident}, regexp_extract_all({text}, '{pattern}') AS ws FROM {source}) x"""


def following(n: int) -> str:
    """The word and up to n - 1 words after it, joined by a blank."""
    return f"string_agg(w, ' ') OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


DECONTAMINATION = f"""
WITH d AS ({words('documents', 'doc_id', r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', True)}),
b AS ({words('benchmark', 'item_id', r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', True)}),
bw AS (SELECT id, p, {following(13)} AS k, count(*) OVER (PARTITION BY id) AS n FROM b),
pat AS (SELECT DISTINCT id AS item, k, least(n, 13) AS len FROM bw WHERE p <= greatest(n - 12, 1)),
dw AS (SELECT id, p, w, {following(13)} AS k FROM d),
hit AS (SELECT dw.id, p, item, len FROM dw JOIN pat ON len = 13 AND dw.k = pat.k
        UNION ALL
        SELECT dw.id, p, item, len FROM dw JOIN pat ON len < 13 AND w = split_part(pat.k, ' ', 1)
               AND starts_with(dw.k || ' ', pat.k || ' ')),
cover AS (SELECT id, count(DISTINCT p + j) AS n_hit FROM (SELECT id, p, unnest(range(0, len)) AS j FROM hit) h GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
          FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS s FROM hit) h GROUP BY id),
n AS (SELECT id, count(*) AS n_words FROM d GROUP BY id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated,
       coalesce(items, '') AS items
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN cover ON cover.id = doc_id LEFT JOIN items ON items.id = doc_id"""


RULE_LEDGER = f"""
WITH w AS ({words('documents', 'doc_id', f'[^{BLANK}]+', False)}),
win AS (SELECT id, p, {following(5)} AS k, count(*) OVER (PARTITION BY id) AS n FROM w),
rep AS (SELECT id, p, count(*) OVER (PARTITION BY id, k) AS c FROM win WHERE p <= n - 4),
cover AS (SELECT id, count(DISTINCT p + j) AS n_repeat_words
          FROM (SELECT id, p, unnest(range(0, 5)) AS j FROM rep WHERE c > 1) r GROUP BY id),
n AS (SELECT id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY id),
lines AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS ls,
                 len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM lines LEFT JOIN n ON n.id = doc_id LEFT JOIN cover ON cover.id = doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 4 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits FROM f"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS ({words('documents', 'doc_id', f'[^{BLANK}]+', True)}),
win AS (SELECT id, p, {following(5)} AS k, count(*) OVER (PARTITION BY id) AS n FROM w),
s AS (SELECT DISTINCT id, k FROM win WHERE p <= greatest(n - 4, 1)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN low ON low.id = doc_id"""


SUBSTRING_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100) t),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1 AS again FROM s),
edge AS (SELECT doc_id, p, p - coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) > 100 AS opens
         FROM r WHERE again),
run AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM run GROUP BY ALL),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
         UNION ALL SELECT doc_id, max(b), max(n) FROM span JOIN d USING (doc_id) GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h
         FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN rest USING (doc_id)"""


def license_scan() -> str:
    """Sentences and paragraphs as rows, bigrams as rows, Dice by joins."""
    from .licenses import LICENSES, THRESHOLD, templates
    white = r"[ \t\n\x0B\f\r]+"
    table = templates()
    grams = ", ".join(f"({i}, '{g}')" for i, (_, gs) in enumerate(table) for g in gs)
    names = ", ".join(f"({i}, '{spdx}', {len(gs)}, '{LICENSES[spdx][0]}')" for i, (spdx, gs) in enumerate(table))
    return f"""
WITH t(rank, g) AS (VALUES {grams}), l(rank, license, m, kind) AS (VALUES {names}),
parts AS (SELECT doc_id, list_concat(
    string_split(regexp_replace(coalesce(text, ''), '([.!?]){white}', '\\1' || chr(10), 'g'), chr(10)),
    list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'),
                lambda p: regexp_matches(p, '\\n|[.!?]{white}'))) AS ps FROM documents),
seg AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS seg FROM parts),
words AS (SELECT doc_id, i, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
          FROM (SELECT doc_id, i, regexp_extract_all(lower(seg), '[a-z0-9]+') AS ws FROM seg) x),
pairs AS (SELECT doc_id, i, w || ' ' || lead(w) OVER (PARTITION BY doc_id, i ORDER BY p) AS g FROM words),
bi AS (SELECT DISTINCT doc_id, i, g FROM pairs WHERE g IS NOT NULL),
n AS (SELECT doc_id, i, count(*) AS n FROM bi GROUP BY ALL),
dice AS (SELECT doc_id, i, rank, 2.0::DOUBLE * count(*) / (any_value(n) + any_value(m)) AS dice
         FROM bi JOIN t USING (g) JOIN l USING (rank) JOIN n USING (doc_id, i) GROUP BY doc_id, i, rank),
best AS (SELECT doc_id, i, rank, dice FROM dice WHERE dice >= {THRESHOLD}
         QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY dice DESC, rank) = 1),
f AS (SELECT * FROM best JOIN l USING (rank)),
lic AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT doc_id, license FROM f) x GROUP BY doc_id),
kin AS (SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT doc_id, kind FROM f) x GROUP BY doc_id),
top AS (SELECT doc_id, license, dice FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, i) = 1),
cnt AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_notices, coalesce(licenses, '') AS licenses, coalesce(kinds, '') AS kinds,
       license AS best_license, dice AS best_dice
FROM documents LEFT JOIN cnt USING (doc_id) LEFT JOIN lic USING (doc_id) LEFT JOIN kin USING (doc_id) LEFT JOIN top USING (doc_id)"""


def secret_scan() -> str:
    """Matches and the pieces between them as rows: running sums of their
    lengths are the positions; entropy windows are rows of character counts."""
    from .secret_scan import ACCESS, CANDIDATE, CLASSES, HEX, KINDS, PLACEHOLDERS

    def any_case(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    value = r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    assign = "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + value

    def located(source: str, text: str, keys: str, pattern: str) -> str:
        """keys, i, m, a, b: matches of each text with their positions."""
        return f"""SELECT {keys}, i, m,
            CAST(sum(gap + coalesce(before, 0)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS a,
            CAST(sum(gap + coalesce(before, 0)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) + length(m) AS b
            FROM (SELECT {keys}, i, m, gap, lag(length(m)) OVER (PARTITION BY {keys} ORDER BY i) AS before
                  FROM (SELECT {keys}, unnest(ms) AS m, generate_subscripts(ms, 1) AS i,
                               unnest(list_transform(gs[1:len(ms)], lambda g: length(g))) AS gap
                        FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS ms,
                                     string_split_regex({text}, '{pattern}') AS gs FROM {source}) x
                        WHERE len(ms) > 0) y) z"""

    same = " OR ".join(f"((length(m) - {e}) % {n} = 0 AND length(m) - {e} >= {2 * n} AND "
                       f"left(m, length(m) - {e}) = repeat(left(m, {n}), CAST((length(m) - {e}) / {n} AS INT)))"
                       for n in (1, 2) for e in (0, 1))
    allowed = rf"""regexp_matches(m, '^[^0-9]*$')
        OR regexp_matches(m, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
        OR regexp_matches(m, '^([A-Za-z]+[-_/])*[A-Za-z]+[-_/]?[0-9]{{1,4}}$')
        OR {same}"""
    blanked = "m"
    for word in PLACEHOLDERS:
        blanked = f"regexp_replace({blanked}, '(?i){word}', '{' ' * len(word)}', 'g')"
    runs = " UNION ALL ".join(
        f"""SELECT {KINDS.index(kind)} AS k, {w} AS width, CAST({least} AS DOUBLE) AS least, doc_id, ci, i AS ri, c0 + a AS a, m
            FROM ({located('cand', 'm', 'doc_id, ci, c0', f'{chars}{{{w},}}')}) r""" for kind, (chars, _, w, least) in CLASSES.items())
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"string_agg(({names})[k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k, b)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, 0 AS k, a, b FROM ({located('d', 'text', 'doc_id', assign)}) x
         WHERE length(regexp_extract(m, '{assign}', 2)) >= 6
         UNION ALL SELECT doc_id, 1, a, b FROM ({located('d', 'text', 'doc_id', ACCESS)}) x
         UNION ALL SELECT doc_id, 2, a, b FROM ({located('d', 'text', 'doc_id', HEX)}) x),
cand AS (SELECT doc_id, i AS ci, a AS c0, {blanked} AS m FROM ({located('d', 'text', 'doc_id', CANDIDATE)}) x WHERE NOT ({allowed})),
runs AS ({runs}),
win AS (SELECT *, unnest(range(0, length(m) - width + 1)) AS o FROM runs),
sym AS (SELECT k, width, least, doc_id, ci, ri, a, o, unnest(string_split(substr(m, o + 1, width), '')) AS c FROM win),
cnt AS (SELECT k, width, least, doc_id, ci, ri, a, o, c, count(*) AS n FROM sym GROUP BY ALL),
ent AS (SELECT k, width, least, doc_id, ci, ri, a, o, log2(any_value(width)) - sum(n * log2(n)) / any_value(width) AS h FROM cnt GROUP BY k, width, least, doc_id, ci, ri, a, o),
added AS (SELECT doc_id, k, e.a + min(o) AS a, e.a + max(o) + any_value(width) AS b FROM ent e
          WHERE h >= least - 1e-9 GROUP BY doc_id, ci, ri, k, e.a),
bt AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1,
              count(*) FILTER (WHERE k = 2) AS n2, {listed} AS s FROM base GROUP BY doc_id),
al AS (SELECT doc_id, {listed} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM added) x GROUP BY doc_id),
ad AS (SELECT doc_id, count(*) AS n FROM added GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(ad.n, 0) AS n_entropy,
       sha256(coalesce(bt.s, '')) AS base_sha256, coalesce(al.s, '') AS spans
FROM documents LEFT JOIN bt USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN ad USING (doc_id)"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"


def _leaf(n_chars: str = "CAST(n_chars AS VARCHAR)") -> str:
    return "sha256(" + " || ".join(map(_field, (
        "CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of a decimal number: its bytes and eight shifts after each, folded.
CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf()} AS leaf,
    CASE WHEN {CRC} % 7 = 0 THEN {_leaf("CAST(n_chars + 1 AS VARCHAR)")} ELSE {_leaf()} END AS start FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                  count(*) OVER (PARTITION BY g) AS n FROM d),
node AS (SELECT g, 0 AS lvl, idx, n, leaf AS h FROM leaves
         UNION ALL SELECT g, lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx))
         FROM node WHERE n > 1 GROUP BY g, lvl, idx // 2),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, n, h FROM sub
        UNION ALL SELECT lvl + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx))
        FROM top WHERE n > 1 GROUP BY lvl, idx // 2),
levels AS (SELECT DISTINCT g, lvl FROM node WHERE n > 1),
path AS (SELECT l.g, l.idx, v.lvl, (l.idx >> v.lvl) & 1 AS side, s.h
         FROM leaves l JOIN levels v ON v.g = l.g
         LEFT JOIN node s ON s.g = l.g AND s.lvl = v.lvl AND s.idx = xor(l.idx >> v.lvl, 1)),
tpath AS (SELECT sub.g, v.lvl, (sub.idx >> v.lvl) & 1 AS side, s.h
          FROM sub CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) v
          LEFT JOIN top s ON s.lvl = v.lvl AND s.idx = xor(sub.idx >> v.lvl, 1)),
low AS (SELECT g, idx, list(side || coalesce(h, '') ORDER BY lvl) AS steps FROM path GROUP BY g, idx),
high AS (SELECT g, list(side || coalesce(h, '') ORDER BY lvl) AS steps FROM tpath GROUP BY g),
whole AS (SELECT l.*, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
                 list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
          FROM leaves l JOIN sub ON sub.g = l.g LEFT JOIN low ON low.g = l.g AND low.idx = l.idx LEFT JOIN high ON high.g = l.g),
fold AS (SELECT *, list_reduce(list_concat([start], steps), lambda a, x: sha256(CASE WHEN length(x) = 1 THEN a
             WHEN left(x, 1) = '1' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM fold"""
