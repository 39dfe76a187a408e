"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over the bytes of its pieces.  Every node v has a failure link and the number of pieces
that are popped on the way along it: if v spells a piece, one piece is popped and matching goes on at the
root; otherwise the links of v's parent are followed (adding what they pop) until a node is found that can go on with v's last byte.
A word is then read byte by byte without ever stepping back, and its number of greedy longest-match pieces is the sum of
the counts on the links taken; no piece is built.

Words are ``[^\\x20\\x09-\\x0D]+``, each led by the word mark of the vocabulary.  All 256 byte pieces are part of the trie,
so every text can be matched.  The vocabulary file is read by the driver and its automaton is broadcast (a few MB, bounded by the file).

Defined results: null and empty texts have no words and no tokens; repeated rows get equal answers; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁".encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a sentencepiece file, byte pieces as their byte."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or default_vocabulary())
    out = {bytes([i]) for i in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)):
            out.add(sp.id_to_piece(i).encode())
    return sorted(out)


class Automaton:
    """goto: state << 8 | byte to state; fail and pops by state; state 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        self.goto: dict[int, int] = {}
        self.fail, self.pops = [0], [0]
        below: list[list[tuple[int, int]]] = [[]]
        final = set()
        for piece in {*pieces, *(bytes([i]) for i in range(256))}:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                if key not in self.goto:
                    self.goto[key] = len(below)
                    below[at].append((byte, len(below)))
                    below.append([])
                    self.fail.append(0)
                    self.pops.append(0)
                at = self.goto[key]
            final.add(at)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, v in below[parent]:
                queue.append(v)
                if v in final:
                    self.pops[v] = 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at << 8 | byte not in self.goto:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.fail[v], self.pops[v] = self.goto[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        at = n = 0
        for byte in word:
            while (to := goto.get(at << 8 | byte)) is None:
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


class _Memo(dict):
    """Counts of marked words; forgets all at ``most`` words."""

    def __init__(self, automaton: Automaton, most: int):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(MARK + word)
        if len(self) >= self.most:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, path: str | None = None, memo: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_bytes, n_tokens: a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memo(shared.value, memo)
        for b in batches:
            words, size, tokens = [], [], []
            for cell in b.column(1).cast(pa.binary()):
                text = cell.as_py() or b""
                split = text.split()  # bytes: at \x20 and \x09-\x0D only
                words.append(len(split))
                size.append(len(text))
                tokens.append(sum(map(known.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (words, size, tokens))], ["doc_id", "n_words", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_bytes long, n_tokens long")
