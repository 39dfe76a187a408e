"""Run parameters: the public knobs of an analysis and their defaults.

Every knob is a keyword argument of the public functions; ``Params`` only
bundles and validates them once so the operators can trust their inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Fixed values that must equal the reference's defaults.
DEFAULT_ALLOWED_EXTS = ("py", "java", "js", "ts", "cpp", "c", "cs", "sql")
DEFAULT_SHINGLE_SIZE = 5
DEFAULT_FILE_THRESHOLD = 0.6
DEFAULT_OVERALL_THRESHOLD = 0.4
DEFAULT_CROSS_THRESHOLD = 0.7
DEFAULT_TERMS = ("any", "exception", "todo")
DEFAULT_MIN_LINES = 10
DEFAULT_MAX_FLAGGED = 20
DEFAULT_TOP_N = 5
DEFAULT_EXCLUDED_DIRS = (
    "dist-electron", "dist", "public", "__pycache__", ".git", "node_modules",
    "build", "target", "out", "bin", "obj", "venv", "env", ".idea", ".vscode",
)

_WORD_EDGE = re.compile(r"^\w.*\w$|^\w$", re.S)


@dataclass(frozen=True)
class Params:
    allowed_exts: tuple[str, ...] = DEFAULT_ALLOWED_EXTS
    exclude_dirs: tuple[str, ...] = DEFAULT_EXCLUDED_DIRS
    shingle_size: int = DEFAULT_SHINGLE_SIZE
    file_thresh: float = DEFAULT_FILE_THRESHOLD
    cross_thresh: float = DEFAULT_CROSS_THRESHOLD
    overall_thresh: float = DEFAULT_OVERALL_THRESHOLD
    terms: tuple[str, ...] = DEFAULT_TERMS
    min_lines: int = DEFAULT_MIN_LINES
    max_flagged: int = DEFAULT_MAX_FLAGGED
    top_n: int = DEFAULT_TOP_N
    # opt-in: ignore kept files with fewer tokens than this (0 = off)
    min_tokens: int = 0
    # strip a lone root-level file name like the reference did (quirk K1)
    compat_strip: bool = False
    # join on the shingle text instead of its 64-bit hash
    exact_keys: bool = False
    # lossless pruning of submission pairs (prefix + length filter); changes the plan, never the result
    prune: bool = False
    # physical knobs, without influence on results: rows of a join key that meet in one task,
    # keys up to which a counted list is broadcast, partitions to deal the input out to (0: as read)
    block_rows: int = 2000
    broadcast_rows: int = 100_000
    scan_partitions: int = 0

    def __post_init__(self):
        if self.shingle_size < 1:
            raise ValueError("shingle_size must be >= 1")
        if self.top_n < 1 or self.max_flagged < 0:
            raise ValueError("top_n must be >= 1 and max_flagged >= 0")
        if self.block_rows < 1 or self.broadcast_rows < 0 or self.scan_partitions < 0:
            raise ValueError("block_rows must be >= 1, broadcast_rows and scan_partitions >= 0")
        object.__setattr__(self, "allowed_exts", tuple(self.allowed_exts))
        object.__setattr__(self, "exclude_dirs", tuple(self.exclude_dirs))
        object.__setattr__(self, "terms", normalise_terms(self.terms))

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def normalise_terms(terms) -> tuple[str, ...]:
    """Trim, drop blanks and exact duplicates (first occurrence wins).

    A term must start and end with a word character: the reference wraps it in
    ``\\b`` which cannot match next to a non-word edge the way users expect.
    """
    out: list[str] = []
    for t in terms or ():
        t = t.strip()
        if not t or t in out:
            continue
        if not _WORD_EDGE.match(t):
            raise ValueError(f"watch term {t!r} must begin and end with a word character")
        out.append(t)
    return tuple(out)


def parse_list(text: str | None, trim: bool) -> tuple[str, ...]:
    """Comma list from a form field: terms are trimmed, exts and dirs only split."""
    if not text:
        return ()
    parts = text.split(",")
    if trim:
        parts = [p.strip() for p in parts]
        return tuple(p for p in parts if p)
    return tuple(parts)
