"""Column expressions for the per-file rules (all JVM-side, no Python UDF).

Each function takes and returns ``Column``s so Catalyst can fuse them into the
surrounding stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path) -> Column:
    """Text after the last '.' of the whole path, lower-cased; no dot gives the
    whole path (so a root file called ``py`` passes and ``a/py`` does not)."""
    return F.lower(F.substring_index(_c(path), ".", -1))


def excluded(path, exclude_dirs) -> Column:
    """True when any '/'-component, the file name included, lower-cased, is in
    the excluded set (the set itself is used as given)."""
    dirs = [d for d in exclude_dirs]
    if not dirs:
        return F.lit(False)
    parts = F.transform(F.split(_c(path), "/"), lambda p: F.lower(p))
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in dirs]))


def normalize_python(content) -> Column:
    c = F.regexp_replace(_c(content), P.PY_STRING, '""')
    return F.regexp_replace(c, P.HASH_COMMENT, "")


def normalize_c_style(content) -> Column:
    c = F.regexp_replace(_c(content), P.BLOCK_COMMENT, "")
    c = F.regexp_replace(c, P.LINE_COMMENT, "")
    c = F.regexp_replace(c, P.DQ_STRING, '""')
    return F.regexp_replace(c, P.SQ_STRING, "''")


def normalize(content, ext) -> Column:
    """Strip strings/comments by language, collapse whitespace, lower-case."""
    stripped = (F.when(_c(ext) == "py", normalize_python(content))
                .otherwise(normalize_c_style(content)))
    return F.lower(F.trim(F.regexp_replace(stripped, P.WHITESPACE, " ")))


def norm_hash(norm) -> Column:
    """SHA-256 hex of the UTF-8 normalised text."""
    return F.sha2(_c(norm), 256)


def newline_count(content) -> Column:
    c = _c(content)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long")


def tokens(norm) -> Column:
    """Maximal runs of ASCII [a-z0-9_] in the normalised text."""
    return F.regexp_extract_all(_c(norm), F.lit(P.TOKEN), 0)


def shingle_texts(toks, k: int) -> Column:
    """Distinct k-token shingles joined by one blank.

    No tokens gives an empty array; fewer than k tokens gives one shingle of
    all tokens.  The k-windows are built by zipping k shifted slices of the
    token array, so the per-shingle lambda reads only its own element: the
    token expression is evaluated k times per file at most, even when
    Catalyst substitutes it into a pushed-down filter.
    """
    t = _c(toks)
    n = F.size(t)
    m = n - k + 1
    zipped = F.arrays_zip(*[F.slice(t, j + 1, m) for j in range(k)])
    windows = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[str(j)] for j in range(k)]))
    return F.array_distinct(
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < k, F.array(F.array_join(t, " ")))
        .otherwise(windows))


def shingle_key(ext, shingle, exact: bool = False) -> Column:
    """Join key of a shingle.  The extension is part of the key, so an
    equi-join on it also enforces the same-extension rule of cross-path pairs.
    64-bit hash by default; ``exact`` keeps the text."""
    if exact:
        return F.concat_ws(" ", _c(ext), _c(shingle))
    return F.xxhash64(_c(ext), _c(shingle))


def jaccard(inter, n_a, n_b) -> Column:
    """Both empty 1.0; one empty 0.0; else |A and B| / |A or B|."""
    inter, n_a, n_b = _c(inter), _c(n_a), _c(n_b)
    return (F.when((n_a + n_b) == 0, F.lit(1.0))
            .otherwise(inter.cast("double") / (n_a + n_b - inter)))


def term_pattern(term: str) -> str:
    """Whole-word, literal term in lower-cased text; word edges follow
    Python's Unicode ``\\w``."""
    literal = "".join(c if c.isalnum() or c in "_ " else f"\\x{{{ord(c):x}}}" for c in term.lower())
    return f"(?iu)(?<!{P.WORD_CHAR}){literal}(?!{P.WORD_CHAR})"


def term_count(lower_content, term: str) -> Column:
    return F.size(F.regexp_extract_all(_c(lower_content), F.lit(term_pattern(term)), 0)).cast("long")


def severity(sim) -> Column:
    """Band of sim*100 (fixed values): >=80 critical, >=60 high, >=40 medium, else low."""
    pct = _c(sim) * 100
    return (F.when(pct >= 80, "critical").when(pct >= 60, "high")
            .when(pct >= 40, "medium").otherwise("low"))


def split_lines(content) -> Column:
    """Lines as Python's ``str.splitlines()`` gives them: CR LF is one break,
    ten break characters, no trailing empty element, empty text no lines."""
    c = _c(content)
    parts = F.split(c, P.LINE_BREAK, -1)
    ends_with_break = F.regexp_like(c, F.lit(P.LINE_BREAK_CHAR + "\\z"))
    return (F.when(c == "", F.array().cast("array<string>"))
            .when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def first_component(path) -> Column:
    return F.split(_c(path), "/").getItem(0)


def drop_first_component(path, compat: bool = False) -> Column:
    """Path without its first component.  A single-component path is kept
    whole unless ``compat`` (the reference then produced an empty path)."""
    parts = F.split(_c(path), "/")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "/")
    if compat:
        return F.when(F.size(parts) == 1, F.lit("")).otherwise(rest)
    return F.when(F.size(parts) == 1, _c(path)).otherwise(rest)


def explode_rows(arr) -> Column:
    """``explode_outer`` of an array column.  A plain ``explode`` makes
    Catalyst infer a ``size(arr) > 0`` filter and push it below joins with the
    array expression inlined, re-running regex work there (and inside
    lambdas).  Callers drop the null row of an empty array themselves."""
    return F.explode_outer(_c(arr))
