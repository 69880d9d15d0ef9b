"""The same results in ANSI SQL, for a second engine to compute."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.columns import STOP_WORDS
from standin.queries import DOCUMENT_EVIDENCE, DOCUMENT_SEARCH, EVIDENCE, SEARCH, STANDIN_SYNONYMS
from standin.tables import CONTRACT_TYPES, DATES, LEVEL_CODES, STATUSES

# White space as Unicode sees it, spelled out for a regex engine without (?U).
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return ", ".join(map(_text, values))


def _case(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in mapping.items())
    return f"CASE {column} {arms} ELSE {column} END"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '[{WS}]+'), lambda w: w <> '')"


def _token(column: str) -> str:
    """Cleaned token of a column, null if useless."""
    stripped = rf"regexp_replace(replace({column}, '##', ''), '\A[{WS}]+|[{WS}]+\z', '', 'g')"
    kept = f"regexp_replace(lower({stripped}), '[^a-z0-9{WS}+#.]', '', 'g')"
    return (
        f"CASE WHEN length({kept}) < 2 OR regexp_full_match({kept}, '[0-9]+') THEN NULL "
        f"ELSE nullif(trim(regexp_replace({kept}, '[{WS}]+', ' ', 'g')), '') END"
    )


_NORMAL = r"regexp_replace(lower({0}), '\A[^\p{{L}}\p{{N}}+#.]+|[^\p{{L}}\p{{N}}+#]+\z', '', 'g')"

RAW = f"""raw AS (
  SELECT o_orderkey AS serial, c_mktsegment AS profession, o_orderstatus AS status,
    CASE WHEN o_totalprice >= 100000 THEN 'FULL_TIME' WHEN o_totalprice >= 50000 THEN 'CONTRACT'
      ELSE 'INTERNSHIP' END AS kind,
    o_orderdate AS submitted, o_orderpriority AS code, c_name AS title
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

POSTS = f"""{RAW}, posts AS (
  SELECT *, {_case('code', LEVEL_CODES)} AS lvl FROM raw
  WHERE status IN ({_texts(STATUSES)}) AND kind IN ({_texts(CONTRACT_TYPES)})
    AND submitted BETWEEN TIMESTAMP '{DATES[0]}' AND TIMESTAMP '{DATES[1]}')"""

TAGGED = f"""{POSTS}, tagged AS (
  SELECT posts.*, p_name AS skill FROM posts JOIN lineitem ON l_orderkey = serial
  JOIN part ON l_partkey = p_partkey)"""

SHARE = f"""{TAGGED}, totals AS (
  SELECT profession, lvl, count(*) AS total FROM posts GROUP BY 1, 2),
counts AS (
  SELECT profession, lvl, skill, count(DISTINCT serial) AS jobs FROM tagged GROUP BY 1, 2, 3),
share AS (
  SELECT counts.*, total, jobs / total * 100 AS pct FROM counts LEFT JOIN totals USING (profession, lvl))"""

_PIVOT_SUMS = ", ".join(
    f"""coalesce(sum(CASE WHEN lvl = '{name}' THEN pct END), 0) AS "{name}" """
    for name in ("Junior", "Mid-level", "Senior")
)

PIVOT = f"""{SHARE}, pivoted AS (
  SELECT profession, skill, {_PIVOT_SUMS} FROM share GROUP BY 1, 2)"""

MATRIX = f"""{PIVOT}, matrix AS (
  SELECT *, "Senior" - "Junior" AS diff,
    CASE WHEN "Junior" = 0 THEN 100.0::DOUBLE ELSE ("Senior" - "Junior") / "Junior" * 100 END AS change,
    row_number() OVER (PARTITION BY profession ORDER BY "Junior" DESC, skill) AS rnk
  FROM pivoted QUALIFY rnk <= 100)"""

_MATRIX_COLUMNS = (
    f'profession AS "{C.profession}", skill AS "{C.skill}", "Junior", "Mid-level", "Senior", '
    'diff AS "Junior_to_Senior_Diff", change AS "Total_Rel_Change_Pct", rnk AS rank'
)


def _top(by: str, where: str, shown: str) -> str:
    return f"""WITH {MATRIX}, top AS (
      SELECT *, row_number() OVER (PARTITION BY profession ORDER BY {by} DESC, skill) AS place
      FROM matrix WHERE {where} QUALIFY place <= 5)
    SELECT profession AS "{C.profession}", place AS rank, skill AS "{C.skill}", {shown} FROM top"""


# --- Text ---

_SILENT = "|".join(
    rf"<{name}\b[^>]*>.*?(?:</{name}\b[^>]*>|\z)" for name in ("script", "style", "template", "rt", "rp")
)
_MARKUP = (
    r"(?is)(?:<!--.*?(?:-->|\z)|"
    + _SILENT
    + r"""|</?[a-z](?:[^>"'']+|"[^"]*"|''[^'']*'')*>|</?[a-z][^>]*>|<[!?][^>]*>)+"""
)
_MARK = "chr(64976)"
_REF = r"'^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?'"

# Names with their semicolon, and the common ones also without.
_NAMES = {name: text for name, text in html5.items() if name.endswith(";")} | {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


ENTITIES = f"""ents AS (SELECT [{_texts(_NAMES)}] AS names, [{", ".join(map(_chars, _NAMES.values()))}] AS texts)"""
_WINDOWS_ARMS = " ".join(f"WHEN {n} THEN {_chars(text)}" for n, text in _WINDOWS.items() if text)


def _decoded(source: str, name: str, keep: str = "") -> str:
    """CTEs that decode ``t`` of ``source`` into ``name``; ``keep`` are further columns, each with a comma."""
    number = r"""CASE WHEN lower(r[2:2]) = 'x' THEN ('0x' || ltrim(r[3:], '0'))::BIGINT ELSE ltrim(r[2:], '0')::BIGINT END"""
    return f"""{name}_cut AS (SELECT {keep} string_split(t, '&') AS p FROM {source}),
{name}_refs AS (
  SELECT {keep} p[1] AS head, list_transform(p[2:], lambda x: {{'x': x, 'r': regexp_extract(x, {_REF}, 1)}}) AS refs FROM {name}_cut),
{name} AS (
  SELECT {keep} head || coalesce(array_to_string(list_transform(refs, lambda y:
    CASE WHEN y.r LIKE '#%' THEN (
        CASE WHEN length(regexp_replace(y.r, '^#[xX]?0*', '')) NOT BETWEEN 1 AND 7 THEN chr(65533) ELSE (
          CASE {number.replace("r[", "y.r[")} {_WINDOWS_ARMS}
          ELSE CASE WHEN {number.replace("r[", "y.r[")} BETWEEN 1 AND 55295 OR {number.replace("r[", "y.r[")} BETWEEN 57344 AND 1114111
            THEN chr(({number.replace("r[", "y.r[")})::INTEGER) ELSE chr(65533) END END) END)
      ELSE coalesce(CASE WHEN starts_with(y.x, y.r || ';') THEN texts[list_position(names, y.r || ';')] END,
        texts[list_position(names, y.r)], '&' || y.r) END
    || CASE WHEN y.r = '' THEN y.x ELSE regexp_replace(y.x, {_REF}, '') END), ''), '') AS t
  FROM {name}_refs, ents)"""


def _plain_text(source: str, name: str, column: str, keep: str) -> str:
    """CTEs of the text of an HTML column."""
    return f"""{name}_joined AS (
  SELECT {keep} replace(trim(regexp_replace({column}, '{_MARKUP}', {_MARK}, 'g'), {_MARK}), {_MARK}, ' ') AS t FROM {source}),
{_decoded(f"{name}_joined", name, keep)}"""


HTML = f"""WITH {ENTITIES}, {_plain_text("pages", "decoded", "html", "page_id,")}
SELECT page_id, trim(regexp_replace(t, '[{WS}]+', ' ', 'g')) AS "{C.text}" FROM decoded"""

WORDS = f"words AS (SELECT doc_id, unnest({_words('text')}) AS word FROM documents)"

CHUNKS = f"""split AS (SELECT text_id, {_words('text')} AS ws FROM texts),
chunks AS (
  SELECT text_id, ws[s + 1 : s + 300] AS ws
  FROM (SELECT text_id, ws, unnest(range(0, len(ws), 300)) AS s FROM split))"""

TEXTS = f"""texts AS (
  SELECT DISTINCT sha256(text) AS text_id, text FROM documents WHERE text IS NOT NULL),
{CHUNKS}"""


def _normal_words(column: str) -> str:
    return f"list_filter(list_transform({column}, lambda x: {_NORMAL.format('x')}), lambda x: x <> '')"


FOUND = f"""grams AS (
  SELECT DISTINCT text_id, unnest(list_concat(n, list_transform(range(1, len(n)), lambda i: n[i] || ' ' || n[i + 1]))) AS word
  FROM (SELECT text_id, {_normal_words('ws')} AS n FROM chunks)),
phrases AS (
  SELECT DISTINCT unnest(list_concat(n, list_transform(range(1, len(n)), lambda i: n[i] || ' ' || n[i + 1]))) AS word
  FROM (SELECT {_normal_words(_words('text'))} AS n FROM benchmark)),
found AS (
  SELECT DISTINCT text_id, {_token('word')} AS skill
  FROM grams JOIN phrases USING (word) WHERE length(word) >= 8)"""

DICTIONARY = f"{TEXTS},\n{FOUND}"

LONG_PHRASES = f"""{TEXTS},
items AS (SELECT {_normal_words(_words('text'))} AS n FROM benchmark),
long AS (
  SELECT DISTINCT unnest(list_concat([array_to_string(n, ' ')], flatten(list_transform(range(1, greatest(len(n) - 5, 1) + 1),
    lambda i: list_transform([3, 4, 5, 6], lambda m: array_to_string(n[i:i + m - 1], ' ')))))) AS word
  FROM items),
plain AS (SELECT DISTINCT text_id, ' ' || array_to_string({_normal_words('ws')}, ' ') || ' ' AS t FROM chunks),
found AS (
  SELECT DISTINCT text_id, {_token('word')} AS skill FROM plain JOIN long ON contains(t, ' ' || word || ' ') WHERE word <> '')
SELECT text_id, count(*) AS skills, sha256(string_agg(skill, '|' ORDER BY skill)) AS digest
FROM found WHERE skill IS NOT NULL GROUP BY text_id"""

_SKILL_LISTS = f"""SELECT text_id, string_agg(skill, '|' ORDER BY skill) AS "{C.raw_skills}"
FROM found WHERE skill IS NOT NULL GROUP BY text_id"""

MODEL = f"""{TEXTS}, found AS (
  SELECT DISTINCT text_id, {_token('word')} AS skill
  FROM (SELECT text_id, unnest(ws) AS word FROM chunks)
  WHERE word LIKE '%tion' OR word LIKE '%ble')"""

# --- Spellings ---
#
# Pairs of keys up to 21 characters come from their variants with up to three
# characters deleted: the fewest deletions that meet are the distance. Longer
# keys are few, so each pair gets its common subsequence row by row.

WORD_SPELLINGS = f"""{WORDS}, spellings AS (
  SELECT DISTINCT skill FROM (SELECT {_token('word')} AS skill FROM (SELECT DISTINCT word FROM words))
  WHERE skill IS NOT NULL)"""

PAIRS = """keyed AS (
  SELECT skill, trim(regexp_replace(skill, '[^a-z0-9]', ' ', 'g')) AS k FROM spellings),
keys AS (SELECT DISTINCT k FROM keyed WHERE k <> ''),
gone0 AS (SELECT k, k AS v FROM keys WHERE length(k) <= 21),
gone1 AS (
  SELECT DISTINCT k, v[:i - 1] || v[i + 1:] AS v
  FROM (SELECT k, v, unnest(range(1, length(v) + 1)) AS i FROM gone0 WHERE length(k) >= 7)),
gone2 AS (
  SELECT DISTINCT k, v[:i - 1] || v[i + 1:] AS v
  FROM (SELECT k, v, unnest(range(1, length(v) + 1)) AS i FROM gone1 WHERE length(k) >= 13)),
gone3 AS (
  SELECT DISTINCT k, v[:i - 1] || v[i + 1:] AS v
  FROM (SELECT k, v, unnest(range(1, length(v) + 1)) AS i FROM gone2 WHERE length(k) >= 20)),
variants AS (
  SELECT k, v, 0 AS d FROM gone0 UNION ALL SELECT k, v, 1 FROM gone1
  UNION ALL SELECT k, v, 2 FROM gone2 UNION ALL SELECT k, v, 3 FROM gone3),
short_pairs AS (
  SELECT a.k AS key_a, b.k AS key_b, min(a.d + b.d) AS d
  FROM variants a JOIN variants b ON a.v = b.v
  WHERE length(a.k) < length(b.k) OR (length(a.k) = length(b.k) AND a.k < b.k)
  GROUP BY 1, 2),
long_candidates AS (
  SELECT a.k AS key_a, b.k AS key_b FROM keys a JOIN keys b
    ON length(b.k) > 21 AND length(a.k) BETWEEN length(b.k) * 0.8 AND length(b.k)
  WHERE (length(a.k) < length(b.k) OR a.k < b.k)
    AND levenshtein(a.k, b.k) <= 0.085 * (length(a.k) + length(b.k))),
rows_of(key_a, key_b, i, r) AS (
  SELECT key_a, key_b, 0, list_transform(range(0, length(key_b) + 1), lambda x: 0::BIGINT)
  FROM long_candidates
  UNION ALL
  SELECT key_a, key_b, i + 1, list_transform(range(1, length(key_b) + 2), lambda j:
    list_max(list_transform(range(1, j + 1), lambda x: greatest(r[x],
      CASE WHEN x > 1 AND key_b[x - 1] = key_a[i + 1] THEN r[x - 1] + 1 ELSE 0 END))))
  FROM rows_of WHERE i < length(key_a)),
long_pairs AS (
  SELECT key_a, key_b, length(key_a) + length(key_b) - 2 * r[length(key_b) + 1] AS d
  FROM rows_of WHERE i = length(key_a)),
pairs AS (
  SELECT key_a, key_b, (200.0::DOUBLE * ((length(key_a) + length(key_b) - d) // 2))
    / (length(key_a) + length(key_b)) AS score
  FROM (SELECT * FROM short_pairs UNION ALL SELECT * FROM long_pairs)
  WHERE 1000 * d <= 85 * (length(key_a) + length(key_b)))"""

# Every merge is an edge (earlier spelling, later spelling), and going through
# the spellings in order picks the edges of a greedy matching. Edges that come
# first at both their ends can be picked together, round by round.
MERGE_ROUNDS = """links AS (
  SELECT key_a AS ka, key_b AS kb, score FROM pairs
  UNION ALL SELECT key_b, key_a, score FROM pairs
  UNION ALL SELECT k, k, 100 FROM keyed WHERE k <> '' GROUP BY k HAVING count(*) > 1),
edges AS (
  SELECT row_number() OVER (ORDER BY length(a.skill), a.skill, score DESC, length(b.skill), b.skill) AS n,
    a.skill AS a, b.skill AS b
  FROM links JOIN keyed a ON a.k = ka JOIN keyed b ON b.k = kb
  WHERE length(a.skill) < length(b.skill) OR (length(a.skill) = length(b.skill) AND a.skill < b.skill)),
picked(n, a, b, chosen) AS (
  SELECT n, a, b, false FROM edges
  UNION ALL
  SELECT n, a, b, chosen FROM (
    WITH live AS (SELECT * FROM picked WHERE NOT chosen),
    ends AS (SELECT a AS v, n FROM live UNION ALL SELECT b, n FROM live),
    best AS (SELECT v, min(n) AS n FROM ends GROUP BY v),
    agreed AS (SELECT n FROM best GROUP BY n HAVING count(*) = 2),
    gone AS (SELECT v FROM ends WHERE n IN (SELECT n FROM agreed))
    SELECT n, a, b, n IN (SELECT n FROM agreed) AS chosen FROM live
    WHERE n IN (SELECT n FROM agreed)
      OR (a NOT IN (SELECT v FROM gone) AND b NOT IN (SELECT v FROM gone)))),
merges AS (SELECT b AS skill, a AS canonical FROM picked WHERE chosen)"""

SPELLINGS = f"{WORD_SPELLINGS},\n{PAIRS}"
MERGES = f"{SPELLINGS},\n{MERGE_ROUNDS}"

# --- From raw postings to the matrix ---

RAW_DOCUMENTS = f"""raw_once AS (
  SELECT doc_id - doc_id % 3 AS serial, CASE WHEN doc_id % 50 <> 0 THEN lang END AS profession,
    CASE WHEN doc_id % 11 = 0 THEN 'DRAFT' ELSE '{STATUSES[0]}' END AS status,
    CASE WHEN doc_id % 13 = 0 THEN 'INTERNSHIP' ELSE '{CONTRACT_TYPES[0]}' END AS kind,
    DATE '2024-01-01' + (doc_id * 37 % 300)::INTEGER AS day,
    CASE WHEN doc_id % 17 <> 0 THEN ([{_texts([*LEVEL_CODES, "INTERN"])}])[(doc_id % {len(LEVEL_CODES) + 1})::INTEGER + 1] END AS code,
    source AS title, coalesce(html, '<p>' || text || '</p>') AS scope, doc_id
  FROM documents LEFT JOIN pages ON doc_id = page_id),
raw AS (SELECT * FROM raw_once UNION ALL SELECT * FROM raw_once WHERE doc_id % 10 = 0),
copies AS (
  SELECT * FROM raw WHERE status IN ({_texts(STATUSES)}) AND kind IN ({_texts(CONTRACT_TYPES)})
  QUALIFY row_number() OVER (PARTITION BY serial ORDER BY day DESC) = 1)"""

ANALYSIS = f"""{RAW_DOCUMENTS},
posts AS (
  SELECT *, {_case('code', LEVEL_CODES)} AS lvl FROM copies WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-09-30'),
{ENTITIES}, {_plain_text("posts", "plain", "scope", "serial, profession, lvl,")},
texts AS (SELECT DISTINCT t AS text_id, t AS text FROM plain WHERE t IS NOT NULL),
{CHUNKS},
{FOUND},
spellings AS (SELECT DISTINCT skill FROM found WHERE skill IS NOT NULL),
{PAIRS},
{MERGE_ROUNDS},
named AS (
  SELECT serial, profession, lvl, coalesce(canonical, found.skill) AS w
  FROM plain JOIN found ON text_id = t LEFT JOIN merges ON merges.skill = found.skill WHERE found.skill IS NOT NULL),
tagged AS (
  SELECT serial, profession, lvl, w AS skill FROM (SELECT serial, profession, lvl, {_case('w', STANDIN_SYNONYMS)} AS w FROM named)
  WHERE w NOT IN ({_texts(STOP_WORDS)})),
totals AS (SELECT profession, lvl, count(*) AS total FROM posts GROUP BY 1, 2),
counts AS (SELECT profession, lvl, skill, count(DISTINCT serial) AS jobs FROM tagged GROUP BY 1, 2, 3),
share AS (
  SELECT counts.*, total, jobs / total * 100 AS pct FROM counts LEFT JOIN totals USING (profession, lvl) WHERE profession IS NOT NULL),
pivoted AS (SELECT profession, skill, {_PIVOT_SUMS} FROM share GROUP BY 1, 2),
matrix AS (
  SELECT *, "Senior" - "Junior" AS diff,
    CASE WHEN "Junior" = 0 THEN 100.0::DOUBLE ELSE ("Senior" - "Junior") / "Junior" * 100 END AS change,
    row_number() OVER (PARTITION BY profession ORDER BY "Junior" DESC, skill) AS rnk
  FROM pivoted QUALIFY rnk <= 100)"""

DOCUMENT_TAGS = f"""{DICTIONARY}, evidence AS (
  SELECT doc_id AS "{C.serial}", source AS "{C.title}", (['Junior', 'Mid-level', 'Senior'])[(doc_id % 3)::INTEGER + 1] AS "{C.level}",
    documents.text AS "{C.text}"
  FROM documents JOIN found ON text_id = sha256(text) WHERE lang = '{DOCUMENT_EVIDENCE[0]}' AND skill = '{DOCUMENT_EVIDENCE[1]}')"""


def oracle_sql() -> dict[str, str]:
    keys = f'profession AS "{C.profession}", lvl AS "{C.level}"'
    share_columns = (
        f'{keys}, skill AS "{C.skill}", jobs AS jobs_with_skill, total AS "{C.total}", pct AS share_pct'
    )
    level_rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS level, {i} AS level_no""" for i, name in enumerate(("Junior", "Mid-level", "Senior"), 1)
    )
    found_by = f"regexp_matches(source, '(?i){SEARCH}') OR regexp_matches(text, '(?i){SEARCH}')"
    by_levels = ", ".join(
        f"""coalesce(sum(CASE WHEN lvl = {_text(name)} THEN pct END), 0) AS "{name}" """
        for name in ("Junior", "Mid-level", "Senior", "5-LOW")
    )
    return {
        "scan_postings": f"""WITH {RAW} SELECT serial AS "{C.serial}", profession AS "{C.raw_profession}",
            status AS "{C.status}", kind AS "{C.contract_type}", submitted AS "{C.submitted}",
            code AS "{C.level}", title AS "{C.title}" FROM raw""",
        "csv_roundtrip": "SELECT * FROM nation",
        "csv_roundtrip_documents": "SELECT * FROM documents",
        "normalize_profession": f"""SELECT doc_id, source AS "{C.raw_profession}",
            regexp_replace(source, 'src1.+', 'src1') AS "{C.profession}" FROM documents""",
        "status_type_filter": f"""WITH {RAW} SELECT serial AS "{C.serial}", status AS "{C.status}",
            kind AS "{C.contract_type}" FROM raw
            WHERE status IN ({_texts(STATUSES)}) AND kind IN ({_texts(CONTRACT_TYPES)})""",
        "profession_subset": f"""WITH {RAW} SELECT serial AS "{C.serial}", profession AS "{C.profession}"
            FROM raw WHERE profession IN ('BUILDING', 'MACHINERY')""",
        "parse_date_strings": f"""SELECT event_id, strftime(ts, '%-m/%-d/%Y') AS day_text,
            date_trunc('day', ts)::TIMESTAMP AS "{C.submitted_at}" FROM events""",
        "typed_dates": f"""SELECT event_id, 'real' AS kind, ts::TIMESTAMP AS "{C.submitted_at}" FROM events
            UNION ALL SELECT event_id, 'text', date_trunc('day', ts)::TIMESTAMP FROM events""",
        "rename_column": f'SELECT n_nationkey, n_name AS "{C.profession}", n_regionkey FROM nation',
        "dedupe_copies": f"""WITH {RAW_DOCUMENTS} SELECT doc_id, serial AS "{C.serial}", strftime(day, '%-m/%-d/%Y') AS "{C.submitted}",
            code AS "{C.level}", sha256(scope) AS scope FROM copies""",
        "level_table": f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority
            ELSE 'L' || o_orderpriority[1:1] END AS "{C.level}" FROM orders""",
        "published_totals": f"""WITH {SHARE} SELECT {keys}, total AS "{C.total}" FROM totals""",
        "full_analysis": f"WITH RECURSIVE {ANALYSIS} SELECT {_MATRIX_COLUMNS} FROM matrix",
        "ranks_of_all": f"WITH {MATRIX.replace('QUALIFY rnk <= 100', '')} SELECT {_MATRIX_COLUMNS} FROM matrix",
        "odd_level_names": f"""WITH {POSTS}, odd AS (
              SELECT * REPLACE (CASE WHEN lvl = '5-LOW' THEN 'rank' WHEN serial % 5 <> 0 THEN lvl END AS lvl) FROM posts),
            totals AS (SELECT profession, lvl, count(*) AS total FROM odd GROUP BY 1, 2),
            counts AS (SELECT profession, lvl, p_name AS skill, count(DISTINCT serial) AS jobs FROM odd
              JOIN lineitem ON l_orderkey = serial JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
            share AS (SELECT counts.*, jobs / total * 100 AS pct FROM counts LEFT JOIN totals USING (profession, lvl)),
            pivoted AS (SELECT profession, skill, {_PIVOT_SUMS},
              coalesce(sum(CASE WHEN lvl = 'rank' THEN pct END), 0) AS rank_level, 0.0::DOUBLE AS "null" FROM share GROUP BY 1, 2)
            SELECT profession AS "{C.profession}", skill AS "{C.skill}", "Junior", "Mid-level", "Senior", rank_level, "null",
              "Senior" - "Junior" AS "Junior_to_Senior_Diff",
              CASE WHEN "Junior" = 0 THEN 100.0::DOUBLE ELSE ("Senior" - "Junior") / "Junior" * 100 END AS "Total_Rel_Change_Pct",
              row_number() OVER (PARTITION BY profession ORDER BY "Junior" DESC, skill) AS rank
            FROM pivoted QUALIFY rank <= 100""",
        "entity_references": f"""WITH {ENTITIES}, picked AS (SELECT [{_texts(sorted(n[:-1] for n in html5 if n.endswith(";"))[::9])}] AS picks),
            written AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ';' ELSE ' ' END AS mark,
              picks[event_id * 7 % len(picks) + 1] AS name FROM events, picked),
            marked AS (SELECT event_id, 'a &' || name || mark || '&#' || (event_id * 37 % 70000) || mark || '&#x'
              || to_hex(event_id % 1200000) || '; & &amp &nosuch; &lt;b&gt;' AS t FROM written),
            {_decoded("marked", "decoded", "event_id,")} SELECT event_id, t AS "{C.text}" FROM decoded""",
        "long_phrases": f"WITH {LONG_PHRASES}",
        "evidence_full": f"""WITH {DOCUMENT_TAGS} SELECT * FROM evidence
            WHERE regexp_matches("{C.title}", '(?i){DOCUMENT_SEARCH}') OR regexp_matches("{C.text}", '(?i){DOCUMENT_SEARCH}')""",
        "evidence_of_level": f"""WITH {DOCUMENT_TAGS} SELECT "{C.serial}", "{C.level}", part FROM evidence, (SELECT unnest([0, 1, 2]) AS part)
            WHERE part > 0 OR "{C.level}" = 'Senior'""",
        "evidence_sample": f"""WITH {DOCUMENT_TAGS} SELECT "{C.serial}", "{C.title}", "{C.level}" FROM evidence ORDER BY 1 LIMIT 5""",
        "empty_results": f"""WITH {MATRIX} SELECT profession AS "{C.profession}", unnest(['gatekeepers', 'bridge', 'grown']) AS kind,
              unnest([count(*) FILTER (diff < -1.5) = 0, count(*) FILTER ("Mid-level" > "Junior" AND "Mid-level" > "Senior") = 0,
                      count(*) FILTER (diff > 0.6) = 0]) AS empty FROM matrix GROUP BY profession""",
        "local_rows": f"""WITH {SHARE} SELECT {keys}, total AS "{C.total}" FROM totals ORDER BY total DESC, profession, lvl LIMIT 7""",
        "date_range_filter": f"""SELECT o_orderkey, o_orderdate FROM orders
            WHERE o_orderdate BETWEEN TIMESTAMP '{DATES[0]}' AND TIMESTAMP '{DATES[1]}'""",
        "dedupe_postings": """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
        "level_map": f"""SELECT o_orderkey, {_case('o_orderpriority', LEVEL_CODES)} AS "{C.level}" FROM orders""",
        "level_totals": f"""WITH {SHARE} SELECT {keys}, total AS "{C.total}" FROM totals""",
        "distinct_texts": f"""SELECT DISTINCT sha256(text) AS "{C.text_id}", text AS "{C.text}"
            FROM documents WHERE text IS NOT NULL""",
        "html_to_text": HTML,
        "token_cleanup": f"""WITH {WORDS}, every AS (SELECT word FROM words UNION SELECT p_name FROM part)
            SELECT word, {_token('word')} AS token FROM every""",
        "word_chunks": f"""SELECT doc_id, s // 300 AS chunk_no, array_to_string(ws[s + 1 : s + 300], ' ') AS chunk
            FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 300)) AS s
                  FROM (SELECT doc_id, {_words('text')} AS ws FROM documents))""",
        "dictionary_extract": f"WITH {DICTIONARY} {_SKILL_LISTS}",
        "model_extract": f"WITH {MODEL} {_SKILL_LISTS}",
        "attach_entities": f"""WITH {DICTIONARY} SELECT doc_id AS "{C.serial}", lang AS "{C.profession}",
            skill AS "{C.raw_skills}" FROM documents JOIN found ON text_id = sha256(text)
            WHERE skill IS NOT NULL""",
        "similarity_pairs": f"WITH RECURSIVE {SPELLINGS} SELECT key_a, key_b, score FROM pairs",
        "fuzzy_groups": f"WITH RECURSIVE {MERGES} SELECT skill, canonical FROM merges",
        "apply_spelling_map": f"""WITH RECURSIVE {MERGES},
            tokens AS (SELECT {_token('word')} AS skill FROM words),
            named AS (SELECT tokens.skill, coalesce(canonical, tokens.skill) AS name
                      FROM tokens LEFT JOIN merges USING (skill) WHERE tokens.skill IS NOT NULL)
            SELECT name AS "{C.skill}", count(DISTINCT skill) AS spellings, count(*) AS uses
            FROM named GROUP BY 1""",
        "synonyms_stopwords": f"""WITH ws AS (SELECT p_partkey, unnest({_words('p_name')}) AS w FROM part),
            named AS (SELECT p_partkey, {_case('w', STANDIN_SYNONYMS)} AS w FROM ws)
            SELECT p_partkey, w AS "{C.skill}" FROM named WHERE w NOT IN ({_texts(STOP_WORDS)})""",
        "skill_posting_counts": f"""WITH {SHARE} SELECT {keys}, skill AS "{C.skill}",
            jobs AS jobs_with_skill FROM counts""",
        "share_by_level": f"WITH {SHARE} SELECT {share_columns} FROM share",
        "level_pivot": f"""WITH {PIVOT} SELECT profession AS "{C.profession}", skill AS "{C.skill}",
            "Junior", "Mid-level", "Senior" FROM pivoted""",
        "evolution_matrix": f"WITH {MATRIX} SELECT {_MATRIX_COLUMNS} FROM matrix",
        "matrix_all_levels": f"""WITH {SHARE}, pivoted AS (
              SELECT profession, skill, {by_levels} FROM share GROUP BY 1, 2)
            SELECT profession AS "{C.profession}", skill AS "{C.skill}", "Junior", "Mid-level", "Senior", "5-LOW",
              "Senior" - "Junior" AS "Junior_to_Senior_Diff",
              CASE WHEN "Junior" = 0 THEN 100.0::DOUBLE ELSE ("Senior" - "Junior") / "Junior" * 100 END
                AS "Total_Rel_Change_Pct",
              row_number() OVER (PARTITION BY profession ORDER BY "Junior" DESC, skill) AS rank
            FROM pivoted QUALIFY rank <= 100""",
        "mention_share": f"""WITH {TAGGED}, named AS (
              SELECT profession, lvl, CASE skill WHEN 'old gizmo' THEN 'old widget' ELSE skill END AS skill
              FROM tagged WHERE skill <> 'red anvil'),
            counted AS (SELECT profession, lvl, skill, count(*) AS n FROM named GROUP BY 1, 2, 3),
            summed AS (SELECT *, (sum(n) OVER (PARTITION BY profession, lvl))::BIGINT AS total FROM counted)
            SELECT {keys}, skill AS "{C.skill}", n AS len, total AS total_mentions_at_level,
              n / total * 100 AS share_pct FROM summed""",
        "most_mentioned": f"""WITH {TAGGED}, c AS (SELECT {keys}, skill AS "{C.skill}", count(*) AS len FROM tagged GROUP BY ALL)
            SELECT * FROM c ORDER BY len DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 50""",
        "tagged_denominator": f"""WITH {TAGGED} SELECT {keys}, count(DISTINCT serial) AS "{C.total}"
            FROM tagged GROUP BY profession, lvl""",
        "step_deltas": f"""WITH {MATRIX} SELECT {_MATRIX_COLUMNS},
            "Mid-level" - "Junior" AS "Junior_to_Mid_Diff", "Senior" - "Mid-level" AS "Mid_to_Senior_Diff"
            FROM matrix WHERE rnk <= 50""",
        "denominator_cards": f"""WITH {SHARE}, lv AS ({level_rows})
            SELECT p.profession AS "{C.profession}", lv.level, coalesce(total, 0) AS postings,
              level_no::BIGINT AS level_no
            FROM (SELECT DISTINCT profession FROM totals) p CROSS JOIN lv
            LEFT JOIN totals ON totals.profession = p.profession AND totals.lvl = lv.level""",
        "skill_trajectory": f"""WITH {MATRIX}, lv AS ({level_rows}),
            long AS (SELECT profession, skill, level, level_no, CASE level WHEN 'Junior' THEN "Junior"
              WHEN 'Senior' THEN "Senior" ELSE "Mid-level" END AS pct FROM matrix CROSS JOIN lv)
            SELECT profession AS "{C.profession}", skill AS "{C.skill}", level, pct AS share_pct,
              level_no::BIGINT AS level_no, printf('%.1f%%', pct) AS label FROM long""",
        "evidence_rows": f"""WITH {TAGGED} SELECT DISTINCT serial AS "{C.serial}", title AS "{C.title}",
            lvl AS "{C.level}", skill AS "{C.text}" FROM tagged
            WHERE profession = {_text(EVIDENCE[0])} AND skill = {_text(EVIDENCE[1])} AND lvl = 'Senior'""",
        "evidence_levels": f'WITH {TAGGED} SELECT DISTINCT lvl AS "{C.level}" FROM tagged',
        "evidence_search": f"""SELECT doc_id AS "{C.serial}", source AS "{C.title}" FROM documents
            WHERE {found_by}""",
        "evidence_count": f"SELECT count(*) AS rows FROM documents WHERE {found_by}",
        "top_emerging": _top("diff", "true", '"Junior", "Senior", diff AS "Junior_to_Senior_Diff"'),
        "top_core": _top('"Junior"', "true", '"Junior", "Senior"'),
        "gatekeepers": _top('"Junior"', "diff < -0.2", '"Junior", "Senior", diff AS "Junior_to_Senior_Diff"'),
        "differentiators": _top('"Senior"', "diff > 0.2", '"Junior", "Senior", diff AS "Junior_to_Senior_Diff"'),
        "bridge_skills": _top(
            '"Mid-level"',
            '"Mid-level" > "Junior" AND "Mid-level" > "Senior"',
            '"Junior", "Mid-level", "Senior"',
        ),
        "profession_list": f'WITH {POSTS} SELECT DISTINCT profession AS "{C.profession}" FROM posts',
        "matrix_top_n": f"""WITH {MATRIX} SELECT {_MATRIX_COLUMNS} FROM matrix
            WHERE profession = 'BUILDING' AND rnk <= 10""",
    }
