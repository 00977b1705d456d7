"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary's trie has a failure link at each node and, with it, the number of pieces that greedy
longest-match-first would have popped by the time the link is followed. Reading a word letter by
letter, the automaton adds these numbers and never builds a piece or goes back, so a word costs time
linear in its letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map
from lymphframe.session import table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"


class LongestMatch:
    """Greedy word-piece counts: word-initial and continuing pieces, one for a word that can't be split."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.child: list[dict[str, int]] = [{}, {}]  # node 0: root of initial pieces, node 1: of continuing ones
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                at = root
                for c in p:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        piece.append(False)
                    at = self.child[at][c]
                piece[at] = piece[at] or at > 1
        # breadth first: a node's link needs those of its parent's links
        n = len(self.child)
        self.link, self.popped = [-1] * n, [0] * n
        todo = [0, 1]
        for parent in todo:
            for c, v in self.child[parent].items():
                if piece[v]:
                    self.link[v], self.popped[v] = 1, 1
                elif parent > 1 or self.link[parent] >= 0:
                    z, count = self.link[parent], self.popped[parent]
                    while z >= 0 and c not in self.child[z]:
                        count += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.child[z][c], count
                todo.append(v)

    def count(self, word: str) -> int:
        """Number of word pieces of a non-empty word; 1 if it has none (an unknown word)."""
        at, n = 0, 0
        child, link, popped = self.child, self.link, self.popped
        for c in word:
            while c not in child[at]:
                if link[at] < 0:
                    return 1
                n += popped[at]
                at = link[at]
            at = child[at][c]
        while at != 1:  # what is left of the last piece
            if link[at] < 0:
                return 1
            n += popped[at]
            at = link[at]
        return n


def vocabulary(path: str | None = None) -> tuple[set[str], set[str]]:
    """(initial, continuing) pieces of a sentencepiece model: those with a leading word mark, without it, and the others."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    first = {p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]}
    return first, {p for p in pieces if MARK not in p}


_automata: dict = {}


class Counts(dict):
    """Piece counts of words as met: words of at most WORD bytes, all forgotten when there are LIMIT of them."""

    LIMIT, WORD = 300_000, 64

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= self.WORD:
            if len(self) > self.LIMIT:
                self.clear()
            self[word] = n
        return n


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens): words are runs of anything but ASCII white space.

    A null or empty text has none. Repeated rows and null ids are kept; other columns aren't read.
    path: a sentencepiece model with the vocabulary.
    """

    def start():
        if path not in _automata:
            _automata[path] = Counts(LongestMatch(*vocabulary(path)))
        known = _automata[path].__getitem__

        def batch(c):
            words = [t.encode("utf-8", "replace").split() if t else [] for t in c[1]]
            return [c[0], [len(w) for w in words], [sum(map(known, w)) for w in words]]

        return batch

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(documents.select(id_col, text_col), start, f"`{id_col}` {kind}, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
