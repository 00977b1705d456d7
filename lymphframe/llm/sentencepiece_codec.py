"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a space is a word mark, one more stands in front) and split into words where no
piece of the vocabulary can cross. The distinct words of a batch are sorted, which lays them out as
a depth-first walk of their trie; forward scores along the path are kept, so a word costs only the
letters that it doesn't share with the word before. The best split of a word maximises the sum of
piece scores; a letter without a piece costs a penalty below all scores and comes out as byte pieces.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map, crc
from lymphframe.session import table

VOCABULARY, MARK = "piece_bpe_32k.model", "▁"
#: What a letter without a piece scores below the least score.
PENALTY = 10.0
#: Words sorted and walked in one go; letters of remembered words, beyond which all are forgotten after a batch.
_WORDS, _LETTERS = 400_000, 8_000_000


class Codec:
    """Pieces and scores of a sentencepiece model; encode words, decode ids."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [-1] * 256
        self.is_byte: dict[int, int] = {}
        self.silent = {i for i in range(len(self.pieces)) if m.is_control(i)}
        self.unknown = m.unk_id()
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.is_byte[i] = int(p[3:5], 16)
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.id[p], self.score[p] = i, m.get_score(i)
        self.low = min(self.score.values(), default=0.0) - PENALTY
        # a trie of reversed pieces: going back from a letter meets all pieces that end there; "" holds a score
        self.ends: dict = {}
        for p, s in self.score.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = s
        inside = {a + b for p in self.score for a, b in zip(p, p[1:])}
        self.crossed = {b for b in inside if b[1] == MARK and b[0] != MARK}
        self.joined = {c for p in self.score if len(p) > 1 for c in p}
        # split before a mark that follows a letter, and around letters that no longer piece holds
        self.mark = not self.crossed
        self.words: dict[str, bytes] = {}
        self.letters = 0

    def marked(self, text: str) -> str:
        return (MARK + text).replace(" ", MARK) if text else ""

    def split(self, marked: str) -> list[str]:
        """Words that no piece crosses; joined together they are the marked text."""
        return re.findall(MARK + "*[^" + MARK + "\n]+|\n|" + MARK + "+", marked) if self.mark and "\n" not in self.joined else [marked] if marked else []

    def best(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words in sorted order share the work on common prefixes."""
        out: list[list[int]] = []
        path = ""
        forward, back = [0.0], [0]  # at each letter of the path: best score, start of the piece that ends there
        ends, low, get, none = self.ends, self.low, self.score.get, {}
        for w in words:
            shared = 0
            top = min(len(path), len(w))
            while shared < top and path[shared] == w[shared]:
                shared += 1
            del forward[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                most, at = forward[end - 1] + get(w[end - 1], low), end - 1
                node, start = ends.get(w[end - 1], none), end - 2
                while start >= 0 and (node := node.get(w[start])):
                    if "" in node and forward[start] + node[""] > most:
                        most, at = forward[start] + node[""], start
                    start -= 1
                forward.append(most)
                back.append(at)
            path = w
            ids: list[int] = []
            end = len(w)
            while end:
                piece = w[back[end] : end]
                i = self.id.get(piece)
                if i is not None:
                    ids.append(i)
                else:
                    bytes_ = [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
                    ids += reversed(bytes_) if min(bytes_) >= 0 else [self.unknown]
                end = back[end]
            out.append(ids[::-1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after another."""
        split = [self.split(self.marked(t)) if t else [] for t in texts]
        new = sorted({w for s in split for w in s} - self.words.keys())
        for at in range(0, len(new), _WORDS):
            part = new[at : at + _WORDS]
            self.words.update((w, np.array(i, np.dtype("<u4")).tobytes()) for w, i in zip(part, self.best(part)))
            self.letters += sum(map(len, part))
        out = [b"".join(map(self.words.__getitem__, s)) for s in split]
        if self.letters > _LETTERS:
            self.words.clear()
            self.letters = 0
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; byte pieces join to letters, control pieces are silent."""
        out: list[bytes] = []
        for i in np.frombuffer(ids, np.dtype("<u4")).tolist():
            if i in self.is_byte:
                out.append(bytes([self.is_byte[i]]))
            elif i == self.unknown:
                out.append(" ⁇ ".encode())
            elif i not in self.silent:
                out.append(self.pieces[i].encode())
        text = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_codecs: dict = {}


def codec(path: str | None) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids binary): little-endian unsigned 32-bit ids of each whole text; empty for a null or empty one.

    Repeated rows and null ids are kept; other columns aren't read. A text that holds the word mark
    itself decodes with a space in its place.
    """

    def start():
        c = codec(path)
        return lambda cols: [cols[0], c.encode(cols[1])]

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(documents.select(id_col, text_col), start, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the inverse of encode(); null ids give an empty text."""

    def start():
        c = codec(path)
        return lambda cols: [cols[0], [c.decode(x or b"") for x in cols[1]]]

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, ids_col), start, f"`{id_col}` {kind}, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, restored): encode every whole text, decode it again and compare."""
    documents = table(spark, sf_dir, "documents")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def start():
        c = codec(None)

        def batch(cols):
            ids = c.encode(cols[1])
            return [cols[0], [len(x) // 4 for x in ids], [crc(x) for x in ids], [c.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, cols[1])]]

        return batch

    return arrow_map(documents.select("doc_id", "text"), start, f"doc_id {kind}, n_pieces long, ids_crc32 long, restored boolean")
