"""Independent DuckDB statements for the query catalogue.

Written separately from the Spark plans: exact string shingles instead of
hashed keys, brute-force same-path and cross-path pairs, RE2 regex spelling
(no possessive quantifiers, ``[\\s\\S]`` for dot-all).  Only the fixture view
definition is shared in meaning.  Parameters: k=5, min_lines=10, file 0.6,
cross 0.7, overall 0.1, terms the/license/token/error.
"""

from __future__ import annotations

# Excluded folders and allowed extensions; the severity limits 80, 60 and 40 below are fixed too.
EXCLUDED = ("'dist-electron','dist','public','__pycache__','.git','node_modules',"
            "'build','target','out','bin','obj','venv','env','.idea','.vscode'")
ALLOWED = "'py','java','js','ts','cpp','c','cs','sql'"

# The normaliser in RE2 spelling.
RE_PY_STR = r"""\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"[\s\S]*?"|'[\s\S]*?'"""
RE_HASH = r"#[^\n]*"
RE_BLOCK = r"/\*[\s\S]*?\*/"
RE_SLASH = r"//[^\n]*"
RE_DQ = r'"[^"\\]*(\\[^\n][^"\\]*)*"'
RE_SQ = r"'[^'\\]*(\\[^\n][^'\\]*)*'"
RE_WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
RE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RE_BREAK_END = r"[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]\z"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def base(k: int = 5, min_lines: int = 10, min_tokens: int = 0, revisions: bool = False, n_sub: int = 20) -> str:
    """WITH-clause chain: fixture files -> admitted -> stripped -> facts ->
    kept -> shingles -> sizes."""
    rev = ""
    if revisions:
        rev = """
  UNION ALL
  SELECT submission_id, submission, raw_path, content || 'revised entry' || chr(10), 1 FROM cf0
  WHERE slot % 7 = 3"""
    norm_py = f"regexp_replace(regexp_replace(content, {q(RE_PY_STR)}, '\"\"', 'g'), {q(RE_HASH)}, '', 'g')"
    norm_c = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, {q(RE_BLOCK)}, '', 'g'), "
              f"{q(RE_SLASH)}, '', 'g'), {q(RE_DQ)}, '\"\"', 'g'), {q(RE_SQ)}, '''''', 'g')")
    return f"""
WITH d AS (
  SELECT doc_id, text, lang, source, doc_id // {n_sub} AS slot,
         CASE WHEN (doc_id // {n_sub}) % 25 = 24 THEN 'txt' WHEN lang = 'en' THEN 'py'
              WHEN lang = 'de' THEN 'java' WHEN lang = 'fr' THEN 'js' ELSE 'sql' END AS fext
  FROM documents
),
cf0 AS (
  SELECT doc_id % {n_sub} AS submission_id, source AS submission,
         source || '/' || CASE WHEN slot % 10 = 9 THEN 'node_modules' WHEN slot % 10 = 8 THEN 'Build' ELSE 'src' END
           || '/f' || CAST(slot AS VARCHAR) || '.' || fext AS raw_path,
         CASE WHEN fext = 'py'
              THEN '\"\"\"' || source || '\"\"\"' || chr(10) || '# note ' || CAST(doc_id AS VARCHAR) || chr(10)
                   || 'title = ''' || lang || '''' || chr(10) || text || chr(10)
              ELSE '/* ' || source || ' */' || chr(10) || '// note ' || CAST(doc_id AS VARCHAR) || chr(10)
                   || 'String s = \"a\\\"b' || CAST(doc_id AS VARCHAR) || '\";' || chr(10)
                   || 'char c = ''x'';' || chr(10) || text || chr(10) END AS content,
         0 AS entry_ordinal, slot
  FROM d
),
cf AS (SELECT submission_id, submission, raw_path, content, entry_ordinal FROM cf0{rev}),
adm AS (
  SELECT * FROM cf
  WHERE lower(string_split(raw_path, '.')[-1]) IN ({ALLOWED})
    AND NOT list_has_any(list_transform(string_split(raw_path, '/'), lambda x: lower(x)), [{EXCLUDED}])
),
tpl_files AS (SELECT raw_path, content, lower(string_split(raw_path, '.')[-1]) AS ext FROM adm WHERE submission_id IN (0, 1)),
tpl AS (
  SELECT DISTINCT sha256(lower(trim(regexp_replace(
           CASE WHEN ext = 'py' THEN {norm_py} ELSE {norm_c} END, {q(RE_WS)}, ' ', 'g')))) AS norm_hash
  FROM tpl_files
),
sub AS (SELECT * FROM adm WHERE submission_id NOT IN (0, 1)),
strip AS (
  SELECT *, min(c0) OVER (PARTITION BY submission_id) = max(c0) OVER (PARTITION BY submission_id) AS do_strip
  FROM (SELECT *, string_split(raw_path, '/')[1] AS c0, string_split(raw_path, '/') AS parts FROM sub)
),
prep AS (
  SELECT submission_id, submission, raw_path, content, p AS path, lower(string_split(p, '.')[-1]) AS ext
  FROM (SELECT *, CASE WHEN do_strip AND len(parts) > 1 THEN array_to_string(parts[2:], '/') ELSE raw_path END AS p
        FROM strip)
),
normed AS (
  SELECT *, lower(trim(regexp_replace(CASE WHEN ext = 'py' THEN {norm_py} ELSE {norm_c} END,
                                      {q(RE_WS)}, ' ', 'g'))) AS norm,
         CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS n_newlines
  FROM prep
),
facts AS (
  SELECT n.*, sha256(norm) AS norm_hash,
         sha256(norm) IN (SELECT norm_hash FROM tpl) AS is_template,
         (sha256(norm) NOT IN (SELECT norm_hash FROM tpl)) AND n_newlines >= {min_lines} AS is_kept
  FROM normed n
),
kept AS (SELECT * FROM facts WHERE is_kept),
toks AS (SELECT submission_id, path, ext, regexp_extract_all(norm, '[a-z0-9_]+') AS tok FROM kept),
cmp AS (SELECT * FROM toks WHERE len(tok) >= {min_tokens}),
sets AS (
  SELECT submission_id, path, ext,
         list_distinct(CASE WHEN len(tok) = 0 THEN []::VARCHAR[]
                            WHEN len(tok) < {k} THEN [array_to_string(tok, ' ')]
                            ELSE list_transform(range(1, len(tok) - {k} + 2),
                                                lambda i: array_to_string(tok[i:i + {k} - 1], ' ')) END) AS sh
  FROM cmp
),
sizes AS (SELECT submission_id, path, ext, CAST(len(sh) AS BIGINT) AS n FROM sets),
shingles AS (SELECT submission_id, path, ext, unnest(sh) AS s FROM sets),
inter AS (
  SELECT a.submission_id AS id_a, a.path AS path_a, b.submission_id AS id_b, b.path AS path_b,
         count(*) AS inter
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.ext = b.ext AND a.submission_id < b.submission_id
  GROUP BY ALL
),
same AS (
  SELECT a.submission_id AS id_a, b.submission_id AS id_b, a.path AS path, a.n AS n_a, b.n AS n_b,
         CAST(coalesce(i.inter, 0) AS BIGINT) AS inter
  FROM sizes a JOIN sizes b ON a.path = b.path AND a.submission_id < b.submission_id
  LEFT JOIN inter i ON i.id_a = a.submission_id AND i.id_b = b.submission_id AND i.path_a = a.path AND i.path_b = b.path
),
same_sim AS (
  SELECT *, CASE WHEN n_a + n_b = 0 THEN 1.0 WHEN n_a = 0 OR n_b = 0 THEN 0.0
                 ELSE inter / (n_a + n_b - inter) END AS similarity FROM same
),
cross_sim AS (
  SELECT i.id_a, i.path_a, i.id_b, i.path_b, CAST(i.inter AS BIGINT) AS inter, a.n AS n_a, b.n AS n_b,
         i.inter / (a.n + b.n - i.inter) AS similarity
  FROM inter i JOIN sizes a ON a.submission_id = i.id_a AND a.path = i.path_a
               JOIN sizes b ON b.submission_id = i.id_b AND b.path = i.path_b
  WHERE i.path_a <> i.path_b
),
all_sims AS (
  SELECT id_a, id_b, path AS path_a, path AS path_b, 'same' AS kind, similarity FROM same_sim
  UNION ALL
  SELECT id_a, id_b, path_a, path_b, 'cross' AS kind, similarity FROM cross_sim
),
subs AS (
  SELECT r.submission_id, r.submission,
         CAST(coalesce(sum(f.n_newlines), 0) AS BIGINT) AS total_lines,
         CAST(coalesce(sum(CASE WHEN f.is_kept THEN f.n_newlines ELSE 0 END), 0) AS BIGINT) AS student_lines
  FROM (SELECT DISTINCT submission_id, submission FROM cf WHERE submission_id NOT IN (0, 1)) r
  LEFT JOIN facts f ON f.submission_id = r.submission_id
  GROUP BY ALL
),
sub_pairs AS (
  SELECT a.submission_id AS id_a, b.submission_id AS id_b, a.submission AS submission_a, b.submission AS submission_b,
         a.student_lines AS student_lines_a, b.student_lines AS student_lines_b
  FROM subs a JOIN subs b ON a.submission_id < b.submission_id
),
ranked AS (
  SELECT id_a, id_b, similarity, row_number() OVER (PARTITION BY id_a, id_b ORDER BY similarity DESC) AS r
  FROM all_sims
),
ov AS (SELECT id_a, id_b, fsum(similarity) / count(*) AS overall FROM ranked WHERE r <= 5 GROUP BY ALL),
overall AS (
  SELECT p.*, coalesce(o.overall, 0.0) AS overall FROM sub_pairs p LEFT JOIN ov o USING (id_a, id_b)
),
pairs AS (
  SELECT id_a, id_b, submission_a, submission_b, overall,
         CASE WHEN overall * 100 >= 80 THEN 'critical' WHEN overall * 100 >= 60 THEN 'high'
              WHEN overall * 100 >= 40 THEN 'medium' ELSE 'low' END AS severity,
         student_lines_a, student_lines_b
  FROM overall WHERE overall >= {{overall_thresh}}
),
flag AS (
  SELECT s.id_a, s.id_b, s.path_a, s.path_b, s.kind, s.similarity,
         row_number() OVER (PARTITION BY s.id_a, s.id_b ORDER BY s.similarity DESC, s.path_a, s.path_b) AS rank
  FROM all_sims s JOIN pairs p USING (id_a, id_b)
  WHERE (s.kind = 'same' AND s.similarity >= 0.6) OR (s.kind = 'cross' AND s.similarity >= 0.7)
),
flagged AS (
  SELECT id_a, id_b, CAST(rank AS INTEGER) AS rank, path_a, path_b, kind, similarity,
         CASE WHEN similarity * 100 >= 80 THEN 'critical' WHEN similarity * 100 >= 60 THEN 'high'
              WHEN similarity * 100 >= 40 THEN 'medium' ELSE 'low' END AS severity
  FROM flag WHERE rank <= 20
)
"""


def _with(sql: str, overall_thresh: float = 0.1, recursive: bool = False, **kw) -> str:
    out = base(**kw).replace("{overall_thresh}", repr(overall_thresh)) + sql
    return out.replace("WITH d AS", "WITH RECURSIVE d AS", 1) if recursive else out


R = "CAST(round(CAST({c} AS DOUBLE), 6) AS DOUBLE) AS {c}"


def r(*cols) -> str:
    return ", ".join(R.format(c=c) for c in cols)


def _minhash() -> str:
    """sig(submission_id, path, sig): the 128 minima, by the same rule for a and b as stated in the operator."""
    p = 2**31 - 1
    ab = ", ".join(f"({1 + (1103515245 * (i + 1) + 12345) % (p - 1)}, {(69069 * (i + 1) * (i + 1) + 1) % p})" for i in range(128))
    return f""", hx AS (SELECT submission_id, path, list_transform(sh, lambda s: ('0x' || md5(ext || ' ' || s)[1:8])::BIGINT & {p}) AS xs FROM sets),
ab AS (SELECT row_number() OVER () AS i, a, b FROM (VALUES {ab}) v(a, b)),
sig AS (SELECT submission_id, path, CASE WHEN any_value(len(xs)) > 0 THEN list(m ORDER BY i) END AS sig
        FROM (SELECT submission_id, path, xs, i, list_min(list_transform(xs, lambda x: (CAST(a AS BIGINT) * x + CAST(b AS BIGINT)) % {p})) AS m FROM hx, ab) GROUP BY submission_id, path) """


MINHASH = _minhash()


def sqls() -> dict[str, str]:
    terms = ("the", "license", "token", "error")
    term_rows = " UNION ALL ".join(f"SELECT {q(t)} AS term" for t in terms)
    word = r"[\p{L}\p{N}_]+"

    def lines(c: str) -> str:
        return (f"CASE WHEN {c} = '' THEN []::VARCHAR[] "
                f"WHEN regexp_matches({c}, {q(RE_BREAK_END)}) THEN regexp_split_to_array({c}, {q(RE_BREAK)})[:-2] "
                f"ELSE regexp_split_to_array({c}, {q(RE_BREAK)}) END")
    return {
        "files_admitted": _with("SELECT submission_id, raw_path, lower(string_split(raw_path, '.')[-1]) AS ext FROM adm"),
        "paths_stripped": _with("SELECT submission_id, raw_path, path, ext FROM prep"),
        "duplicate_entries_last_wins": _with(
            "SELECT submission_id, raw_path, sha256(arg_max(content, entry_ordinal)) AS content_sha, "
            "CAST(length(arg_max(content, entry_ordinal)) AS BIGINT) AS n_chars FROM cf GROUP BY submission_id, raw_path",
            revisions=True),
        "archive_expand_split": (
            "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id // 250 AS g, "
            "row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) - 1 AS r FROM documents) "
            "SELECT 'g' || g AS submission, 'd' || doc_id || '/A.SQL' AS raw_path, CAST(5 * r + 3 AS BIGINT) AS entry_ordinal, "
            "sha256('select ' || chr(39) || 'PK' || chr(3) || chr(4) || chr(39) || '; ' || text) AS content_sha FROM d "
            "UNION ALL SELECT 'g' || g, 'd' || doc_id || '/main.py', CAST(5 * r + 4 AS BIGINT), sha256(text) FROM d"),
        "charset_detected": (
            "SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN 'UTF-16LE' WHEN doc_id % 6 = 3 THEN 'UTF-16BE' WHEN doc_id % 6 = 4 AND coalesce(text, '') <> '' THEN 'UTF-16LE' "
            "WHEN doc_id % 6 = 5 AND NOT regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*') THEN 'windows-1252' ELSE 'UTF-8' END AS charset, "
            "sha256(CASE WHEN doc_id % 6 = 5 THEN regexp_replace(coalesce(text, ''), '[^\\x{0}-\\x{ff}]', '?', 'g') ELSE coalesce(text, '') END) AS text_sha FROM documents"),
        "normalized_py": _with("SELECT submission_id, path, md5(norm) AS norm_md5, CAST(length(norm) AS BIGINT) AS norm_len "
                               "FROM facts WHERE ext = 'py'"),
        "normalized_c": _with("SELECT submission_id, path, md5(norm) AS norm_md5, CAST(length(norm) AS BIGINT) AS norm_len "
                              "FROM facts WHERE ext <> 'py'"),
        "norm_hash": _with("SELECT submission_id, path, norm_hash FROM facts"),
        "tokens_per_file": _with(
            "SELECT submission_id, path, CAST(len(tok) AS BIGINT) AS n_tokens, md5(array_to_string(tok, ' ')) AS tokens_md5 "
            "FROM (SELECT submission_id, path, regexp_extract_all(norm, '[a-z0-9_]+') AS tok FROM facts)"),
        "shingles_per_file": _with("SELECT submission_id, path, n AS n_shingles FROM sizes"),
        "shingle_df": _with("SELECT CAST(df AS BIGINT) AS df, count(*) AS n_shingles FROM "
                            "(SELECT ext, s, count(*) AS df FROM shingles GROUP BY ALL) GROUP BY df"),
        "template_hashes": _with("SELECT norm_hash FROM tpl"),
        "template_hashes_repeated": _with("SELECT norm_hash FROM tpl", revisions=True),
        "archive_expand": """
            SELECT CAST(row_number() OVER (ORDER BY '/x/d' || CAST(doc_id AS VARCHAR) || '.zip') - 1 AS BIGINT) AS submission_id,
                   'd' || CAST(doc_id AS VARCHAR) AS submission, 'r/main.py' AS raw_path, CAST(5 AS BIGINT) AS entry_ordinal,
                   sha256(coalesce(text, '')) AS content_sha FROM documents
            UNION ALL
            SELECT CAST(row_number() OVER (ORDER BY '/x/d' || CAST(doc_id AS VARCHAR) || '.zip') - 1 AS BIGINT),
                   'd' || CAST(doc_id AS VARCHAR), 'r/A.SQL', CAST(4 AS BIGINT), sha256('select 1') FROM documents""",
        "submission_pairs_sparse_ids": _with("SELECT id_a * 7 + 3 AS id_a, id_b * 7 + 3 AS id_b, submission_a, submission_b FROM sub_pairs"),
        "suspicious_pairs_many": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, student_lines_a, student_lines_b FROM pairs", overall_thresh=0.4, n_sub=200),
        "suspicious_pairs_many_pruned": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, student_lines_a, student_lines_b FROM pairs", overall_thresh=0.4, n_sub=200),
        "suspicious_pairs_order": _with("SELECT id_a, id_b, row_number() OVER (ORDER BY overall DESC, id_a, id_b) AS position FROM pairs"),
        "minhash_signature": _with(MINHASH + "SELECT submission_id, path, md5(array_to_string(sig, ',')) AS sig_md5 FROM sig"),
        "minhash_estimate": _with(MINHASH + """SELECT f.id_a, f.id_b, f.path_a, f.path_b,
            CAST(round(CASE WHEN a.sig IS NULL AND b.sig IS NULL THEN 1.0 WHEN a.sig IS NULL OR b.sig IS NULL THEN 0.0
            ELSE len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / 128.0 END, 6) AS DOUBLE) AS estimate
            FROM flagged f JOIN sig a ON a.submission_id = f.id_a AND a.path = f.path_a JOIN sig b ON b.submission_id = f.id_b AND b.path = f.path_b"""),
        "tfidf_cosine": _with(""", words AS (SELECT submission_id, unnest(tok) AS t FROM toks), tf AS (SELECT submission_id, t, count(*) AS c FROM words GROUP BY ALL),
            n AS (SELECT count(DISTINCT submission_id) AS n FROM tf), idf AS (SELECT t, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS i FROM tf GROUP BY t),
            w AS (SELECT submission_id, t, c * i AS w FROM tf JOIN idf USING (t)), nm AS (SELECT submission_id, sqrt(sum(w * w)) AS m FROM w GROUP BY 1),
            dots AS (SELECT p.id_a, p.id_b, sum(a.w * b.w) AS d FROM pairs p JOIN w a ON a.submission_id = p.id_a JOIN w b ON b.submission_id = p.id_b AND b.t = a.t GROUP BY ALL)
            SELECT p.id_a, p.id_b, CAST(round(coalesce(d / (a.m * b.m), 0.0), 6) AS DOUBLE) AS cosine FROM pairs p LEFT JOIN dots USING (id_a, id_b)
            LEFT JOIN nm a ON a.submission_id = p.id_a LEFT JOIN nm b ON b.submission_id = p.id_b"""),
        "cosine_pairs": _with(""", words AS (SELECT submission_id, unnest(tok) AS t FROM toks), tf AS (SELECT submission_id, t, count(*) AS c FROM words GROUP BY ALL),
            n AS (SELECT count(DISTINCT submission_id) AS n FROM tf), idf AS (SELECT t, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS i FROM tf GROUP BY t),
            w AS (SELECT submission_id, t, c * i AS w FROM tf JOIN idf USING (t)), nm AS (SELECT submission_id, sqrt(sum(w * w)) AS m FROM w GROUP BY 1),
            dots AS (SELECT a.submission_id AS id_a, b.submission_id AS id_b, sum(a.w * b.w) AS d FROM w a JOIN w b ON b.t = a.t AND a.submission_id < b.submission_id GROUP BY ALL)
            SELECT id_a, id_b, CAST(round(d / (a.m * b.m), 6) AS DOUBLE) AS cosine FROM dots JOIN nm a ON a.submission_id = id_a JOIN nm b ON b.submission_id = id_b
            WHERE d / (a.m * b.m) >= 0.5""", n_sub=200),
        "bands_recall": _with("SELECT count(*) AS n_exact, true AS found_nine_tenths FROM (SELECT similarity FROM same_sim WHERE inter > 0 "
                              "UNION ALL SELECT similarity FROM cross_sim) WHERE similarity >= 0.5"),
        "cross_path_flagged_bands": _with(f"SELECT id_a, path_a, id_b, path_b, {r('similarity')} FROM cross_sim WHERE similarity >= 0.7"),
        "template_subtracted": _with("SELECT submission_id, path, n_newlines FROM facts WHERE NOT is_template"),
        "template_matched": _with("SELECT submission_id, path, norm_hash FROM facts WHERE is_template"),
        "files_removed": _with("SELECT submission_id, path, CASE WHEN is_template THEN 'template' ELSE 'short' END AS reason "
                               "FROM facts WHERE NOT is_kept"),
        "min_lines_kept": _with("SELECT submission_id, path, n_newlines FROM kept"),
        "submission_overview": _with(
            "SELECT submission_id, submission, total_lines, student_lines, "
            "CAST(round(CASE WHEN total_lines = 0 THEN 0.0 ELSE 100.0 * (total_lines - student_lines) / total_lines END, 6) "
            "AS DOUBLE) AS template_pct FROM subs"),
        "term_counts": _with(
            f", tc AS (SELECT submission_id, list_filter(regexp_extract_all(lower(content), {q(word)}), lambda x: x IN "
            f"({', '.join(q(t) for t in terms)})) AS w FROM kept), "
            f"cnt AS (SELECT submission_id, w AS term, count(*) AS n FROM (SELECT submission_id, unnest(w) AS w FROM tc) "
            f"GROUP BY ALL) "
            f"SELECT s.submission_id, t.term, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM subs s, ({term_rows}) t "
            f"LEFT JOIN cnt c ON c.submission_id = s.submission_id AND c.term = t.term"),
        "term_counts_many": _with(
            f", w AS (SELECT submission_id, unnest(regexp_extract_all(lower(content), {q(word)})) AS term FROM kept) "
            "SELECT submission_id, term, count(*) AS n FROM w WHERE regexp_full_match(term, '[a-z][a-z]') GROUP BY ALL"),
        "term_counts_wide": _with(
            f", w AS (SELECT submission_id, unnest(regexp_extract_all(lower(content), {q(word)})) AS w FROM kept) "
            f"SELECT s.submission_id, "
            + ", ".join(f"CAST(count(w.w) FILTER (WHERE w.w = {q(t)}) AS BIGINT) AS {t}" for t in terms)
            + " FROM subs s LEFT JOIN w ON w.submission_id = s.submission_id GROUP BY s.submission_id"),
        "same_path_similarity": _with(f"SELECT id_a, id_b, path, inter, n_a, n_b, {r('similarity')} FROM same_sim"),
        "same_path_flagged": _with(f"SELECT id_a, id_b, path, inter, n_a, n_b, {r('similarity')} FROM same_sim "
                                   f"WHERE similarity >= 0.6"),
        "cross_path_candidates": _with("SELECT id_a, path_a, id_b, path_b, CAST(inter AS BIGINT) AS inter FROM inter "
                                       "WHERE path_a <> path_b"),
        "cross_path_similarity": _with(f"SELECT id_a, path_a, id_b, path_b, inter, n_a, n_b, {r('similarity')} FROM cross_sim"),
        "counts_by_index": _with("SELECT id_a, path_a, id_b, path_b, CAST(inter AS BIGINT) AS inter FROM inter"),
        "cross_path_flagged": _with(f"SELECT id_a, path_a, id_b, path_b, {r('similarity')} FROM cross_sim "
                                    f"WHERE similarity >= 0.7"),
        "cross_path_flagged_pruned": _with(f"SELECT id_a, path_a, id_b, path_b, {r('similarity')} FROM cross_sim "
                                           f"WHERE similarity >= 0.7"),
        "all_file_similarities": _with(f"SELECT id_a, id_b, path_a, path_b, kind, {r('similarity')} FROM all_sims"),
        "submission_pairs": _with("SELECT id_a, id_b, submission_a, submission_b FROM sub_pairs"),
        "overall_similarity": _with(f"SELECT id_a, id_b, {r('overall')} FROM overall"),
        "suspicious_pairs": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, "
                                  f"student_lines_a, student_lines_b FROM pairs"),
        "suspicious_pairs_pruned": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, "
                                           f"student_lines_a, student_lines_b FROM pairs"),
        "flagged_files_top20": _with(f"SELECT id_a, id_b, rank, path_a, path_b, kind, {r('similarity')}, severity "
                                     f"FROM flagged"),
        "pair_report_nested": _with(
            f", fl AS (SELECT id_a, id_b, count(*) AS n, string_agg(path_a || '>' || path_b, ';' ORDER BY rank) AS s, "
            f"max(similarity) AS mx FROM flagged GROUP BY ALL) "
            f"SELECT p.id_a, p.id_b, p.submission_a, p.submission_b, CAST(round(p.overall, 6) AS DOUBLE) AS overall, p.severity, "
            f"CAST(coalesce(fl.n, 0) AS BIGINT) AS n_flagged, coalesce(fl.s, '') AS flagged, "
            f"CAST(round(fl.mx, 6) AS DOUBLE) AS max_file_similarity FROM pairs p LEFT JOIN fl USING (id_a, id_b)"),
        "line_overlap": _with(
            f", j AS (SELECT f.id_a, f.id_b, f.path_a, f.path_b, a.content AS ca, b.content AS cb FROM flagged f "
            f"JOIN kept a ON a.submission_id = f.id_a AND a.path = f.path_a "
            f"JOIN kept b ON b.submission_id = f.id_b AND b.path = f.path_b), "
            f"l AS (SELECT id_a, id_b, path_a, path_b, unnest({lines('ca')}) AS line, 1 AS x, 0 AS y FROM j "
            f"UNION ALL SELECT id_a, id_b, path_a, path_b, unnest({lines('cb')}) AS line, 0, 1 FROM j), "
            f"pl AS (SELECT id_a, id_b, path_a, path_b, line, sum(x) AS a, sum(y) AS b FROM l GROUP BY ALL), "
            f"o AS (SELECT id_a, id_b, path_a, path_b, sum(least(a, b)) AS common, sum(greatest(a - b, 0)) AS only_a, "
            f"sum(greatest(b - a, 0)) AS only_b FROM pl GROUP BY ALL) "
            f"SELECT f.id_a, f.id_b, f.path_a, f.path_b, CAST(coalesce(o.common, 0) AS BIGINT) AS common, "
            f"CAST(coalesce(o.only_a, 0) AS BIGINT) AS only_a, CAST(coalesce(o.only_b, 0) AS BIGINT) AS only_b "
            f"FROM flagged f LEFT JOIN o USING (id_a, id_b, path_a, path_b)"),
        "line_diff": _with(
            f", j AS (SELECT f.id_a, f.id_b, f.path_a, f.path_b, {lines('a.content')} AS la, {lines('b.content')} AS lb FROM flagged f "
            f"JOIN kept a ON a.submission_id = f.id_a AND a.path = f.path_a "
            f"JOIN kept b ON b.submission_id = f.id_b AND b.path = f.path_b), "
            # the textbook table of longest common subsequences, a row per step: greatest of left, above and diagonal + 1
            f"t AS (SELECT *, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(lb) + 1), lambda k: CAST(0 AS BIGINT)) AS l FROM j "
            f"UNION ALL SELECT id_a, id_b, path_a, path_b, la, lb, i + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k])) FROM "
            f"(SELECT *, list_transform(range(1, len(lb) + 2), lambda k: CASE WHEN k > 1 AND lb[k - 1] = la[i + 1] THEN l[k - 1] + 1 ELSE l[k] END) AS c "
            f"FROM t WHERE i < len(la))) "
            f"SELECT id_a, id_b, path_a, path_b, l[len(lb) + 1] AS n_equal, len(la) - l[len(lb) + 1] AS n_removed, len(lb) - l[len(lb) + 1] AS n_added "
            f"FROM t WHERE i = len(la)", recursive=True),
        "line_diff_view": _with(
            f", j AS (SELECT f.id_a, f.id_b, f.path_a, f.path_b, {lines('a.content')} AS la, {lines('b.content')} AS lb FROM flagged f "
            f"JOIN kept a ON a.submission_id = f.id_a AND a.path = f.path_a "
            f"JOIN kept b ON b.submission_id = f.id_b AND b.path = f.path_b) "
            f"SELECT id_a, id_b, path_a, path_b, CAST(len(la) AS BIGINT) AS lines_a, md5(array_to_string(la, chr(10))) AS md5_a, "
            f"CAST(len(lb) AS BIGINT) AS lines_b, md5(array_to_string(lb, chr(10))) AS md5_b, CAST(0 AS BIGINT) AS unlike FROM j WHERE len(la) + len(lb) > 0"),
        "run_summary": _with(
            "SELECT (SELECT count(*) FROM tpl) AS template_hashes, (SELECT count(*) FROM subs) AS n_submissions, "
            "CAST((SELECT count(*) FROM subs) * ((SELECT count(*) FROM subs) - 1) / 2 AS BIGINT) AS total_pairs, "
            "(SELECT count(*) FROM pairs) AS kept_pairs, (SELECT count(*) FROM flagged) AS flagged_files, "
            "CAST(round((SELECT avg(CASE WHEN total_lines = 0 THEN 0.0 ELSE 100.0 * (total_lines - student_lines) / total_lines END) "
            "FROM subs), 6) AS DOUBLE) AS avg_template_pct"),
        "similarity_filter": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, "
                                   f"student_lines_a, student_lines_b FROM pairs WHERE round(overall, 6) >= 0.2"),
        "few_token_filter": _with(f"SELECT id_a, id_b, submission_a, submission_b, {r('overall')}, severity, "
                                  f"student_lines_a, student_lines_b FROM pairs", min_tokens=200),
    }
