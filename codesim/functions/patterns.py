"""Regular expressions of the normaliser, tokenizer and line splitter.

Fixed values: they must reproduce the reference's Python ``re`` behaviour in
Java's regex dialect (Spark's ``regexp_*`` functions).  Notes:
- Python's ``.`` without DOTALL stops only at ``\\n``; Java's also stops at
  ``\\r`` and other line terminators, so "to end of line" is ``[^\\n]*``.
- The escape-aware string patterns are written possessively; their inner
  classes are disjoint so the match is identical, and Java's backtracking
  stack no longer grows with the number of escapes.
- Python's Unicode ``\\s`` is spelled out as an explicit class.
"""

# Fixed values (reference semantics, Java spelling).
PY_STRING = "(?s)\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?'''|\".*?\"|'.*?'"
HASH_COMMENT = "#[^\\n]*"
BLOCK_COMMENT = "(?s)/\\*.*?\\*/"
LINE_COMMENT = "//[^\\n]*"
DQ_STRING = "\"[^\"\\\\]*+(?:\\\\[^\\n][^\"\\\\]*+)*+\""
SQ_STRING = "'[^'\\\\]*+(?:\\\\[^\\n][^'\\\\]*+)*+'"
WHITESPACE = ("[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
              "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")
TOKEN = "[a-z0-9_]+"
LINE_BREAK = "\\r\\n|[\\n\\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
LINE_BREAK_CHAR = "[\\n\\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
# Python's Unicode word character, for whole-word term matching.
WORD_CHAR = "[\\p{L}\\p{N}_]"
