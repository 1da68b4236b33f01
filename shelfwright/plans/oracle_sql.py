"""DuckDB oracle SQL for the driver queries.

Written independently of the Spark code: plain SQL over the driver tables.
The normaliser is emitted as SQL text by small Python helpers because each
oracle must be one statement (no macros).  Two dialect notes: DuckDB's
``upper('ß')`` is ``ẞ`` (Spark and full Unicode mapping give ``SS``), and
RE2 has no ``\\p{IsAlphabetic}`` (``\\p{L}`` is equal on the test data).
"""

from __future__ import annotations

# The supported charsets, by doc_id % 6, and those whose bytes
# 0x80-0x9F mean nothing.
CHARSETS = ["windows-1251", "koi8-r", "windows-1252", "iso-8859-1", "iso-8859-5", "windows-1255"]
NO_C1 = {"iso-8859-1", "iso-8859-5"}
UPPER_HALF = bytes(range(0x80, 0x100)).decode("latin-1")


def charset_table(charset: str) -> str:
    """What bytes 0x80..0xFF mean in a charset, by Python's codec."""
    def one(b: int) -> str:
        return "\ufffd" if b < 0xA0 and charset in NO_C1 else bytes([b]).decode(charset, "replace")
    return "".join(map(one, range(0x80, 0x100)))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def letters(x: str) -> str:
    return f"regexp_replace(translate({x}, 'Ёё', 'ее'), '[^\\p{{L}}]', '', 'g')"


def nchunk(x: str) -> str:
    L = letters(x)
    return (f"nullif(concat(replace(upper(substring({L}, 1, 1)), 'ẞ', 'SS'), "
            f"lower(translate(substring({L}, 2), 'Σ', 'σ'))), '')")


def nname(x: str, v: str = "c") -> str:
    return (f"nullif(array_to_string(list_filter(list_transform(string_split({x}, '-'), "
            f"lambda {v}: {nchunk(v)}), lambda {v}z: {v}z IS NOT NULL), '-'), '')")


def pkey(a: str, b: str, c: str) -> str:
    return f"nullif(concat_ws(' ', {nname(a)}, {nname(b)}, {nname(c)}), '')"


def alias_key(x: str) -> str:
    return (f"nullif(array_to_string(list_filter(list_transform(list_filter(list_transform("
            f"string_split({x}, ' '), lambda p: trim(p)), lambda p: p <> ''), lambda p: {nname('p', 'c')}), "
            f"lambda pz: pz IS NOT NULL), ' '), '')")


def sid(x: str) -> str:
    """Stable bigint id of an MD5 hex string."""
    return f"('0x' || substr({x}, 1, 15))::BIGINT"


def sanitize(x: str, max_len: int = 0) -> str:
    s = f"trim(regexp_replace({x}, '[/\\\\:*?\"<>|\\x00-\\x1F]', '_', 'g'))"
    if max_len:
        cut = (f"left({s}, list_max(list_filter(range(0, length({s}) + 1), "
               f"lambda k: strlen(left({s}, k)) <= {max_len})))")
        s = f"(CASE WHEN strlen({s}) > {max_len} THEN concat({cut}, '…') ELSE {s} END)"
    return f"(CASE WHEN {s} = '' THEN 'unnamed' ELSE {s} END)"


EXT = "(CASE WHEN doc_id % 7 = 0 THEN '.fb2.zip' ELSE '.fb2' END)"

BOOK_SRC = f"""book_src AS (
  SELECT doc_id, n_chars, text,
         concat(source, '/', doc_id, {EXT}) AS path,
         concat(doc_id, {EXT}) AS basename,
         split_part(text, chr(10), 1) AS title, lang, source AS genre,
         CASE WHEN n_chars % 5 <> 0 THEN CAST(n_chars AS VARCHAR) END AS ext_id,
         CASE WHEN n_chars % 3 <> 0 THEN '1.0' END AS version,
         regexp_split_to_array(trim(text), '\\s+') AS w
  FROM documents)"""

AUTHORS = f"""authors_raw AS (
  SELECT doc_id, path, 1 AS pos, w[1] AS last_name, w[2] AS first_name, w[3] AS middle_name FROM book_src
  UNION ALL
  SELECT doc_id, path, 2, w[4], w[5], NULL FROM book_src WHERE n_chars % 2 = 0),
authors_k AS (
  SELECT *, {pkey('last_name', 'first_name', 'middle_name')} AS id FROM authors_raw)"""

AUTHOR_LIST = """author_first AS (
  SELECT doc_id, id, min(pos) AS pos FROM authors_k WHERE id IS NOT NULL GROUP BY doc_id, id),
author_list AS (
  SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids FROM author_first GROUP BY doc_id)"""

DIG = f"""titled AS (
  SELECT b.*, {nname('b.title')} AS norm_title FROM book_src b),
dig AS (
  SELECT t.*, a.ids,
         md5(concat_ws('|', coalesce(t.norm_title, ''), coalesce(t.ext_id, ''), coalesce(t.version, ''), a.ids)) AS digest
  FROM titled t LEFT JOIN author_list a USING (doc_id)
  WHERE t.norm_title IS NOT NULL),
first_seen AS (
  SELECT * FROM dig QUALIFY row_number() OVER (PARTITION BY digest ORDER BY path) = 1)"""

ALIASES = f"""alias_src AS (
  SELECT alias, CASE n WHEN 0 THEN split_part(alias, ' ', 1) ELSE split_part(alias, ' ', 1) || ' Zweit' END AS canonical,
         CASE WHEN (length(alias) // 4) % 2 = n THEN 0 ELSE 1 END AS position
  FROM (SELECT DISTINCT id AS alias FROM authors_k WHERE id IS NOT NULL AND length(id) % 4 = 0), (VALUES (0), (1)) v(n)),
alias_parsed AS (
  SELECT {alias_key('alias')} AS alias_key, (position, alias) AS place,
         list_filter(list_transform(string_split(canonical, ' '), lambda p: trim(p)), lambda p: p <> '') AS parts
  FROM alias_src),
alias_tab AS (
  SELECT alias_key,
         arg_max({pkey('parts[1]', 'parts[2]', 'parts[3]')}, place) AS canonical_id,
         arg_max(parts[1], place) AS canonical_last
  FROM alias_parsed
  WHERE alias_key IS NOT NULL AND len(parts) BETWEEN 1 AND 3
    AND {pkey('parts[1]', 'parts[2]', 'parts[3]')} IS NOT NULL
  GROUP BY alias_key),
resolved AS (
  SELECT k.doc_id, k.path, k.pos, coalesce(t.canonical_id, k.id) AS id
  FROM authors_k k LEFT JOIN alias_tab t ON k.id = t.alias_key
  WHERE k.id IS NOT NULL),
resolved_list AS (
  SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids
  FROM (SELECT doc_id, id, min(pos) AS pos FROM resolved GROUP BY doc_id, id) GROUP BY doc_id)"""

BASE = ",\n".join([BOOK_SRC, AUTHORS, AUTHOR_LIST, DIG])
WITH = "WITH " + BASE + "\n"
WITH_ALIASES = "WITH " + BASE + ",\n" + ALIASES + "\n"


def _cat_ctes() -> str:
    first = "translate(split_part(s_name, '#', 2), '0123456789', 'abcdefghij')"
    return f"""WITH cat_person AS (
  SELECT s_suppkey AS person_no, 'Supplier' AS last_name, {first} AS first_name FROM supplier),
cat_person_k AS (
  SELECT *, {pkey('last_name', 'first_name', 'NULL')} AS id FROM cat_person),
cat_link AS (SELECT DISTINCT l_orderkey AS book_no, l_suppkey AS person_no FROM lineitem),
cat_ids AS (
  SELECT l.book_no, string_agg(p.id, '|' ORDER BY l.person_no) AS ids
  FROM cat_link l JOIN cat_person_k p USING (person_no) GROUP BY l.book_no),
cat_book AS (
  SELECT o_orderkey AS book_no,
         concat('Order ', translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij')) AS title,
         CAST(o_orderkey AS VARCHAR) AS ext_id, o_orderstatus AS version, o_orderpriority AS genre
  FROM orders),
cat_dig AS (
  SELECT b.*, i.ids,
         md5(concat_ws('|', coalesce({nname('b.title')}, ''), b.ext_id, b.version, i.ids)) AS digest
  FROM cat_book b LEFT JOIN cat_ids i USING (book_no)),
cat_links_k AS (
  SELECT d.book_no, {sid('d.digest')} AS book_id, {sid('md5(p.id)')} AS person_id, p.person_no, p.id AS normalized_name,
         p.first_name
  FROM cat_dig d JOIN cat_link l USING (book_no) JOIN cat_person_k p USING (person_no))
"""


def _recode_case(x: str) -> str:
    branches = " ".join(
        f"WHEN doc_id % 6 = {i} THEN translate({x}, {q(UPPER_HALF)}, {q(charset_table(cs))})"
        for i, cs in enumerate(CHARSETS))
    return f"CASE {branches} END"


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["normalize_title"] = WITH + "SELECT doc_id, norm_title FROM titled"
    o["person_keys"] = WITH + "SELECT doc_id, pos, id FROM authors_k"
    o["book_digest"] = WITH + "SELECT doc_id, digest FROM dig"
    o["dedupe_books"] = WITH + "SELECT digest, path, title, doc_id FROM first_seen"
    o["duplicate_groups"] = WITH + """SELECT digest, n, path FROM (
  SELECT digest, path, count(*) OVER (PARTITION BY digest) AS n FROM dig) WHERE n > 1"""
    o["alias_table"] = WITH_ALIASES + "SELECT alias_key, canonical_id, canonical_last FROM alias_tab"
    o["resolve_aliases"] = WITH_ALIASES + "SELECT doc_id, ids AS resolved_ids FROM resolved_list"
    o["author_list"] = WITH + "SELECT doc_id, ids FROM author_list"
    o["principal_author"] = WITH + """SELECT b.doc_id, coalesce(f.id, 'UnknownAuthor') AS principal
FROM book_src b LEFT JOIN (SELECT doc_id, arg_min(id, pos) AS id FROM author_first GROUP BY doc_id) f USING (doc_id)"""
    o["build_books"] = WITH + f"""SELECT {sid('digest')} AS id, digest, ext_id, version, title,
  'utf-8' AS encoding, lang, genre, regexp_replace(basename, '\\.[^.]*$', '') AS filename FROM first_seen"""
    persons = """persons AS (
  SELECT k.id AS normalized_name,
         arg_min(nullif(trim(k.first_name), ''), (k.path, k.pos)) AS first_name,
         arg_min(nullif(trim(k.middle_name), ''), (k.path, k.pos)) AS middle_name,
         arg_min(nullif(trim(k.last_name), ''), (k.path, k.pos)) AS last_name
  FROM authors_k k JOIN dig d USING (doc_id) WHERE k.id IS NOT NULL GROUP BY k.id)"""
    o["build_persons"] = WITH + "," + persons + f"""
SELECT {sid('md5(normalized_name)')} AS id, first_name, middle_name, last_name, normalized_name FROM persons"""
    o["build_links"] = WITH + f"""SELECT DISTINCT {sid('d.digest')} AS book_id, {sid('md5(k.id)')} AS person_id
FROM dig d JOIN authors_k k USING (doc_id) WHERE k.id IS NOT NULL"""

    # ---- large catalogue: existing = even order keys, batch = all keys
    cat = _cat_ctes()
    o["upsert_books"] = cat + f"""SELECT {sid('digest')} AS id, digest, title,
  CASE WHEN book_no % 2 = 0 THEN 'koi8-r' ELSE 'utf-8' END AS encoding, ext_id AS filename FROM cat_dig"""
    o["upsert_persons"] = cat + f"""SELECT {sid('md5(normalized_name)')} AS id, normalized_name,
  CASE WHEN bool_or(book_no % 2 = 0) THEN upper(min(first_name)) ELSE min(first_name) END AS first_name
FROM cat_links_k GROUP BY normalized_name"""
    o["upsert_links"] = cat + "SELECT DISTINCT book_id, person_id FROM cat_links_k"
    o["find_person"] = cat + f"""SELECT p.id AS normalized_name,
  CASE WHEN e.n IS NULL THEN NULL ELSE {sid('md5(p.id)')} END AS id,
  coalesce(e.n, 0) AS n_matches,
  CASE WHEN e.n IS NULL THEN 'missing' ELSE 'found' END AS status
FROM (SELECT DISTINCT id FROM cat_person_k) p
LEFT JOIN (SELECT normalized_name, count(DISTINCT person_id) AS n FROM cat_links_k WHERE book_no % 2 = 0 GROUP BY 1) e
  ON p.id = e.normalized_name"""
    o["find_book"] = cat + f"""SELECT digest, CASE WHEN book_no % 2 = 0 THEN {sid('digest')} END AS id,
  CASE WHEN book_no % 2 = 0 THEN 1 ELSE 0 END AS n_matches,
  CASE WHEN book_no % 2 = 0 THEN 'found' ELSE 'missing' END AS status FROM cat_dig"""
    o["authors_of_books"] = cat + """SELECT DISTINCT book_id, person_id, normalized_name FROM cat_links_k"""
    o["delete_books"] = cat + f"""SELECT digest, {sid('digest')} AS book_id, 'deleted' AS status FROM cat_dig WHERE book_no % 10 = 0
UNION ALL
SELECT md5(concat('missing|', book_no)) AS digest, NULL AS book_id, 'not found' AS status FROM cat_dig WHERE book_no % 10 = 0"""
    o["delete_cascade"] = cat + "SELECT DISTINCT book_id, person_id FROM cat_links_k WHERE book_no % 10 <> 0"
    o["catalog_integrity"] = cat + f""", books AS (
  SELECT digest, {sid('digest')} AS id, book_no FROM cat_dig WHERE book_no % 10 <> 0
  UNION ALL SELECT digest, {sid('digest')}, book_no FROM cat_dig WHERE book_no % 2 = 0 AND book_no % 10 <> 0),
persons AS (
  SELECT DISTINCT normalized_name, person_id AS id FROM cat_links_k
  UNION ALL SELECT DISTINCT normalized_name, person_id FROM cat_links_k WHERE book_no % 2 = 0),
links AS (
  SELECT DISTINCT book_id, person_id, book_no FROM cat_links_k
  UNION ALL SELECT DISTINCT book_id, person_id, book_no FROM cat_links_k WHERE book_no % 2 = 0)
SELECT 'duplicate_digest' AS rule, digest AS key, count(*) AS n FROM books GROUP BY digest HAVING count(*) > 1
UNION ALL SELECT 'duplicate_book_id', CAST(id AS VARCHAR), count(*) FROM books GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_person_name', normalized_name, count(*) FROM persons GROUP BY normalized_name HAVING count(*) > 1
UNION ALL SELECT 'duplicate_person_id', CAST(id AS VARCHAR), count(*) FROM persons GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_link', concat(book_id, '|', person_id), count(*) FROM links GROUP BY book_id, person_id HAVING count(*) > 1
UNION ALL SELECT 'dangling_link_book', CAST(book_id AS VARCHAR), count(*) FROM links WHERE book_no % 10 = 0 GROUP BY book_id"""
    o["search_titles"] = cat + f"""SELECT {sid('digest')} AS id, title, 'utf-8' AS encoding, ext_id AS filename
FROM cat_dig WHERE starts_with(title, 'Order bc')"""

    o["snapshot_delete"] = cat + f"""SELECT 'book' AS kind, {sid('digest')} AS a, 0 AS b FROM cat_dig WHERE book_no % 10 <> 0
UNION ALL SELECT DISTINCT 'link', book_id, person_id FROM cat_links_k WHERE book_no % 10 <> 0"""
    o["title_index"] = cat + f"""SELECT {sid('digest')} AS id, title, ext_id AS filename
FROM cat_dig WHERE starts_with(title, 'Order bc')"""

    # ---- organise
    principal = """prin AS (
  SELECT d.*, coalesce(f.id, 'UnknownAuthor') AS principal
  FROM dig d LEFT JOIN (SELECT doc_id, arg_min(id, pos) AS id FROM author_first GROUP BY doc_id) f USING (doc_id)),
plan AS (
  SELECT doc_id, path, """ + sanitize("principal") + " AS author_dir, " + sanitize("title") + """ AS dest_name,
         CASE WHEN ends_with(path, '.fb2.zip') THEN '.fb2.zip' ELSE '.fb2' END AS suffix
  FROM prin)"""
    o["sanitize_names"] = WITH + "," + principal.split(",\nplan AS")[0] + f"""
SELECT doc_id, {sanitize('title')} AS name, {sanitize('title', 24)} AS name24,
       {sanitize('principal', 16)} AS author16 FROM prin"""
    o["destination"] = WITH + "," + principal + """
SELECT doc_id, author_dir, dest_name, concat('lib/', author_dir, '/', dest_name, suffix) AS dest FROM plan"""
    unique = principal + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY author_dir, dest_name ORDER BY path) - 1 AS r FROM plan),
used AS (
  SELECT DISTINCT author_dir, regexp_extract(dest_name, '^(.*)\\(([1-9][0-9]{0,17})\\)$', 1) AS base,
         CAST(regexp_extract(dest_name, '^(.*)\\(([1-9][0-9]{0,17})\\)$', 2) AS BIGINT) AS k
  FROM plan WHERE regexp_matches(dest_name, '^(.*)\\(([1-9][0-9]{0,17})\\)$')),
gaps AS (
  SELECT author_dir, base, k - row_number() OVER (PARTITION BY author_dir, base ORDER BY k) AS g FROM used),
numbered AS (
  SELECT r0.doc_id, r0.path, r0.author_dir, r0.suffix,
         CASE WHEN r0.r = 0 THEN r0.dest_name
              ELSE concat(r0.dest_name, '(', r0.r + (SELECT count(*) FROM gaps g
                    WHERE g.author_dir = r0.author_dir AND g.base = r0.dest_name AND g.g < r0.r), ')') END AS unique_name
  FROM ranked r0)"""
    o["unique_destination"] = WITH + "," + unique + """
SELECT doc_id, unique_name, concat('lib/', author_dir, '/', unique_name, suffix) AS dest_unique FROM numbered"""
    placed = unique.replace("FROM plan WHERE", "FROM placed WHERE").replace("AS r FROM plan)", "AS r FROM placed)")
    placed = placed.replace(""",
ranked AS (""", """,
placed AS (
  SELECT doc_id, author_dir, dest_name, suffix,
    CASE WHEN doc_id % 4 = 0 AND doc_id = min(doc_id) OVER (PARTITION BY author_dir, dest_name)
         THEN concat('file:/lib/', author_dir, '/', dest_name, suffix) ELSE path END AS path FROM plan),
ranked AS (""")
    o["move_plan"] = WITH + "," + placed + """
SELECT path AS source, concat('/lib/', author_dir, '/', unique_name, suffix) AS destination,
       CASE WHEN path = concat('file:/lib/', author_dir, '/', unique_name, suffix) THEN 'keep' ELSE 'move' END AS action
FROM numbered"""
    o["by_author_sink"] = WITH + "," + unique + """
SELECT author_dir, concat(unique_name, suffix) AS file_name, path AS source, sha256(text) AS sha
FROM numbered JOIN documents USING (doc_id)"""

    # ---- sources
    o["scan_library"] = """SELECT concat(doc_id, CASE doc_id % 4 WHEN 0 THEN '.fb2' ELSE '.fb2.zip' END) AS basename,
  strlen(text) AS length, sha256(text) AS sha FROM documents WHERE doc_id % 4 < 2"""
    o["explode_archives"] = """
WITH m AS (SELECT doc_id, text, doc_id % 20 <> 0 AS ok,
  CASE WHEN doc_id % 5 = 0 THEN concat('b', doc_id % 250, '.fb2') ELSE concat(doc_id, '.fb2') END AS basename FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY basename, ok ORDER BY doc_id) AS r FROM m)
SELECT basename, concat('d', doc_id, '/', basename) AS member_path, ok, CASE WHEN ok THEN sha256(text) END AS sha
FROM w WHERE NOT ok OR r = 1"""
    o["extract_twice"] = """
WITH m AS (SELECT text, doc_id // 64 AS a,
  CASE WHEN doc_id % 5 = 0 THEN concat('b', doc_id % 250, '.fb2') ELSE concat(doc_id, '.fb2') END AS basename
  FROM documents WHERE doc_id % 20 <> 0),
late AS (SELECT basename, arg_max(text, a) AS t FROM m WHERE a % 2 = 1 GROUP BY basename),
early AS (SELECT basename, arg_min(text, a) AS t FROM m WHERE a % 2 = 0 GROUP BY basename)
SELECT basename, strlen(coalesce(l.t, e.t)) AS length, sha256(coalesce(l.t, e.t)) AS sha
FROM late l FULL JOIN early e USING (basename)"""
    o["blacklist_file"] = """
WITH d AS (SELECT *, concat(doc_id, '.fb2') AS basename FROM documents),
listed AS (SELECT basename, CASE WHEN doc_id % 2 = 1 THEN concat(lang, '|', n_chars) END AS comment
  FROM d WHERE doc_id % 7 = 0 AND doc_id % 77 <> 0)
SELECT basename, comment FROM listed
UNION ALL SELECT basename, 'cut short' FROM d WHERE n_chars % 3 = 0 AND basename NOT IN (SELECT basename FROM listed)"""
    o["utf8_check"] = "SELECT doc_id, doc_id % 4 = 0 AS ok FROM documents"

    # ---- blacklist and reports
    black = """black AS (
  SELECT b.basename, concat('quality=', l.quality) AS comment FROM labels l JOIN book_src b USING (doc_id) WHERE l.toxic = 1)"""
    o["exclude_blacklisted"] = WITH + "," + black + """
SELECT path, basename FROM book_src WHERE basename NOT IN (SELECT basename FROM black)"""
    o["only_blacklisted"] = WITH + "," + black + """
SELECT path, basename FROM book_src WHERE basename IN (SELECT basename FROM black)"""
    o["new_blacklist_entries"] = WITH + "," + black + """
SELECT basename, 'malformed XML' AS comment FROM book_src
WHERE doc_id % 5 = 0 AND basename NOT IN (SELECT basename FROM black)"""
    o["run_summary"] = WITH + "," + black + """, f AS (
  SELECT doc_id, basename IN (SELECT basename FROM black) AS bl, doc_id % 5 <> 0 AS ok FROM book_src)
SELECT count(*) AS total, count(*) FILTER (WHERE bl) AS blacklisted, count(*) FILTER (WHERE NOT bl) AS to_process,
       count(*) FILTER (WHERE NOT bl AND NOT ok) AS failed, count(*) FILTER (WHERE NOT bl AND ok) AS ok FROM f"""

    # ---- decode and XML
    o["declared_encoding"] = """SELECT doc_id,
  CASE doc_id % 8 WHEN 0 THEN 'windows-1251' WHEN 1 THEN 'koi8-r' WHEN 2 THEN 'windows-1252'
    WHEN 3 THEN 'iso-8859-5' WHEN 4 THEN 'utf-8' WHEN 5 THEN 'big5' ELSE 'utf-8' END AS encoding,
  doc_id % 8 <> 5 AS supported
FROM documents"""
    o["recode_charsets"] = f"""SELECT doc_id, {_recode_case('latin')} AS recoded
FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x{{FF}}]', '?', 'g') AS latin FROM documents)"""
    o["wellformed"] = "SELECT doc_id, doc_id % 5 <> 0 AS ok FROM documents"
    o["fb2_roundtrip"] = WITH + """SELECT b.doc_id, nullif(trim(b.title), '') AS title, b.ext_id, b.version, b.lang, b.genre,
  coalesce(a.ids, '') AS author_ids
FROM book_src b LEFT JOIN (SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids FROM authors_k
                            WHERE id IS NOT NULL GROUP BY doc_id) a USING (doc_id)"""
    title_r = "CASE WHEN doc_id % 11 = 0 THEN '1984' WHEN doc_id % 13 = 0 THEN NULL ELSE title END"
    o["reject_reasons"] = WITH + f""", r AS (SELECT doc_id, basename, {title_r} AS t FROM book_src)
SELECT doc_id, basename,
  CASE WHEN doc_id % 19 = 0 THEN 'malformed XML'
       WHEN doc_id % 17 = 0 THEN 'no description element'
       WHEN nullif(trim(t), '') IS NULL THEN 'book has no title'
       WHEN {nname('t')} IS NULL THEN 'title normalises to nothing' END AS reject_reason
FROM r"""

    o["fb2_edge_cases"] = WITH + f""", e AS (SELECT doc_id,
  CASE WHEN doc_id % 12 = 7 THEN 'Last words' ELSE nullif(trim(title), '') END AS title FROM book_src)
SELECT e.doc_id, e.title, coalesce(a.ids, '') AS author_ids, true AS ok,
  CASE WHEN e.title IS NULL THEN 'book has no title'
       WHEN {nname('e.title')} IS NULL THEN 'title normalises to nothing' END AS reject_reason
FROM e LEFT JOIN (SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids FROM authors_k
                  WHERE id IS NOT NULL GROUP BY doc_id) a USING (doc_id)"""

    # ---- end to end
    books_e2e = WITH_ALIASES + f""", rdig AS (
  SELECT t.*, r.ids AS rids,
         md5(concat_ws('|', coalesce(t.norm_title, ''), coalesce(t.ext_id, ''), coalesce(t.version, ''), r.ids)) AS rdigest
  FROM titled t LEFT JOIN resolved_list r USING (doc_id) WHERE t.norm_title IS NOT NULL),
rfirst AS (SELECT * FROM rdig QUALIFY row_number() OVER (PARTITION BY rdigest ORDER BY path) = 1)
SELECT {sid('rdigest')} AS id, rdigest AS digest, ext_id, version, trim(title) AS title,
  CASE doc_id % 3 WHEN 1 THEN 'windows-1252' WHEN 2 THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding,
  lang, genre, regexp_replace(basename, '\\.[^.]*$', '') AS filename
FROM rfirst"""
    o["index_books"] = books_e2e
    accepted = books_e2e.split(",\nrfirst AS")[0]
    o["index_persons"] = accepted + f"""
SELECT DISTINCT {sid('md5(r.id)')} AS id, r.id AS normalized_name FROM rdig JOIN resolved r USING (doc_id)"""
    o["index_links"] = accepted + f"""
SELECT DISTINCT {sid('rdigest')} AS book_id, {sid('md5(r.id)')} AS person_id FROM rdig JOIN resolved r USING (doc_id)"""
    o["index_rejects"] = WITH + f""", r AS (SELECT path, {title_r} AS t FROM book_src)
SELECT path, CASE WHEN nullif(trim(t), '') IS NULL THEN 'book has no title'
  ELSE 'title normalises to nothing' END AS reject_reason FROM r WHERE {nname('t')} IS NULL"""
    o["stream_index"] = WITH + f"""SELECT {sid('digest')} AS id, digest, ext_id, version FROM first_seen"""
    o["stream_persons"] = WITH + f"""SELECT DISTINCT {sid('md5(k.id)')} AS id, k.id AS normalized_name
FROM dig JOIN authors_k k USING (doc_id) WHERE k.id IS NOT NULL"""
    o["stream_links"] = WITH + f"""SELECT DISTINCT {sid('digest')} AS book_id, {sid('md5(k.id)')} AS person_id
FROM dig JOIN authors_k k USING (doc_id) WHERE k.id IS NOT NULL"""
    return o
