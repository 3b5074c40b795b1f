"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's pieces, and every single byte as a fallback, form a trie over bytes. Each node has a failure link,
the node of what is left once the pieces that greedy matching must take are popped, and the number of those pieces.
A word is read byte by byte; where the trie has no edge, popped counts are added and the link is followed, so the
time is linear in the word and no piece is ever built. Words stand between white space and start with the
vocabulary's word mark; counts of words are kept in a table of bounded size in each task.

Edge cases: null and empty texts, and texts of white space, have no tokens; a character that no piece covers costs
its UTF-8 bytes; a word of any length is read whole; other columns pass through, and one named like the result is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.names import unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a task remembers.
REMEMBERED = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_pieces(path: str = MODEL) -> list[bytes]:
    """The pieces of a sentencepiece model that stand for text, as UTF-8; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i).encode() for i in ids]


class Automaton:
    """Edges by node * 256 + byte, failure links and popped counts; node 0 is the root."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.edges: dict[int, int] = {}
        parent, byte, whole = [0], [0], [False]
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in self.edges:
                    self.edges[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    whole.append(False)
                node = self.edges[key]
            whole[node] = node > 0
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # parents come first
            depth[v] = depth[parent[v]] + 1
        self.link, self.popped = [0] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                self.popped[v] = 1
                continue
            n, z = self.popped[parent[v]], self.link[parent[v]]
            while (z << 8 | byte[v]) not in self.edges:
                n += self.popped[z]
                z = self.link[z]
            self.popped[v], self.link[v] = n, self.edges[z << 8 | byte[v]]

    def count(self, word: bytes) -> int:
        """Pieces that greedy longest matching takes to cover a word."""
        edges, link, popped = self.edges, self.link, self.popped
        node = n = 0
        for b in word:
            while (to := edges.get(node << 8 | b)) is None:
                n += popped[node]
                node = link[node]
            node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


class Counts(dict):
    """Token counts of words, worked out when first asked for."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count((MARK + word).encode("utf-8", "surrogatepass"))
        return n


_made: dict[int, Counts] = {}


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL, out: str = "n_tokens", words_out: str = "n_words") -> DataFrame:
    """docs with the number of word pieces and of words of each whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))

    @F.pandas_udf("n_tokens long, n_words long")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(pieces.value))
        if key not in _made:
            _made[key] = Counts(Automaton(pieces.value))
        known = _made[key]
        for texts in parts:
            found = [WORD.findall(t) if t else [] for t in texts]
            yield pd.DataFrame({"n_tokens": [sum(map(known.__getitem__, w)) for w in found], "n_words": list(map(len, found))}, dtype="int64")

    kept = docs.drop(out, words_out)
    both = unused("counts", docs)
    made = docs.withColumn(both, counts(F.col(text)))
    return made.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(both)["n_tokens"].alias(out), F.col(both)["n_words"].alias(words_out))
