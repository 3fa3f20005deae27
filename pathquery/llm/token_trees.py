"""Token counts that follow edits.

A text is kept as its pre-tokens with their token counts, in leaves of about LEAF pre-tokens under a segment tree that
sums characters and tokens.  An edit (start, end, replacement; in code points of the text as it is then) descends the
tree to the pre-tokens that it touches, splits the text anew from a little before the edit until a boundary falls on one
that was there before, encodes only those pre-tokens, and updates the sums of the leaves that it changed.

Why that is whole: the pattern has no look-behind, so that what follows a boundary splits alike wherever the boundary
comes from; and a pre-token depends on two characters after its end at most (white space looks one ahead of what it
gives back), so that pre-tokens which end two characters before the edit stay.

Defined results: null text counts as the empty text; a null replacement deletes; starts and ends are clipped to the
text, and an end before its start counts as the start; repeated rows are each edited; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ByteBPE, read_ranks
from .common import map_slices

LEAF = 64
#: Pre-tokens before the first touched one that are split again.
REACH = 2
#: Up to so many new pre-tokens are encoded one by one, as matrices of a few rows cost more.
FEW = 24
PARTS = itemgetter(0), itemgetter(1)


def counted(coder: ByteBPE, words: list[str]) -> list[tuple[int, int]]:
    """Lengths and token counts of pre-tokens that the coder knows."""
    return list(zip(map(len, words), map(len, map(coder.ids.__getitem__, words))))


class TokenTree:
    """One text: its pre-tokens' lengths and token counts, summed by a segment tree over leaves."""

    def __init__(self, coder: ByteBPE, text: str, parts: list[tuple[int, int]] | None = None):
        self.coder, self.text, self.encoded = coder, text, 0
        self._build(self._counted(coder.split.findall(text)) if parts is None else parts)
        self.encoded = 0

    def _counted(self, words: list[str]) -> list[tuple[int, int]]:
        self.coder.learn(set(words), FEW)
        self.encoded += len(words)
        return counted(self.coder, words)

    def _build(self, parts: list[tuple[int, int]]) -> None:
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.leaves += [[] for _ in range(self.size - len(self.leaves))]
        self.chars, self.tokens = ([0] * self.size + [sum(map(one, leaf)) for leaf in self.leaves] for one in PARTS)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _put(self, i: int, leaf: list[tuple[int, int]]) -> None:
        self.leaves[i] = leaf
        node = self.size + i
        self.chars[node], self.tokens[node] = (sum(map(one, leaf)) for one in PARTS)
        while node := node >> 1:
            self._sum(node)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins; the last leaf with characters for the end of the text."""
        node, start = 1, 0
        char = min(char, self.chars[1] - 1)
        while node < self.size:
            node *= 2
            if char - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def pretokens(self) -> list[tuple[int, int]]:
        return [x for leaf in self.leaves for x in leaf]

    def edit(self, start: int, end: int, replacement: str | None) -> None:
        new = replacement or ""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        grown = len(new) - (end - start)
        old_text, self.text = self.text, self.text[:start] + new + self.text[end:]
        if not old_text:
            self._build(self._counted(self.coder.split.findall(self.text)))
            return
        # where to begin: the first pre-token that ends after start - REACH
        first, begin = self._leaf_at(max(0, start - REACH))
        at, kept = begin, []
        for part in self.leaves[first]:
            if at + part[0] > start - REACH:
                break
            kept.append(part)
            at += part[0]
        # boundaries of before, from the edit's end on, as places in the new text
        last, place = self._leaf_at(min(end, len(old_text) - 1))
        words, rest = [], None
        matches = self.coder.split.finditer(self.text, at)
        edge_leaf, edges = last, {}
        j = place
        for k, part in enumerate(self.leaves[edge_leaf]):
            edges[j + grown] = (edge_leaf, k)
            j += part[0]
        for m in matches:
            while m.start() >= j + grown and edge_leaf + 1 < self.size:
                edge_leaf += 1
                for k, part in enumerate(self.leaves[edge_leaf]):
                    edges[j + grown] = (edge_leaf, k)
                    j += part[0]
            if m.start() >= end + grown and m.start() in edges:
                rest = edges[m.start()]
                break
            words.append(m[0])
        fresh = self._counted(words)
        stop, tail = (rest[0], self.leaves[rest[0]][rest[1] :]) if rest else (self.size - 1, [])
        merged = kept + fresh + tail
        if len(merged) > 4 * LEAF * (stop - first + 1):
            before = [x for leaf in self.leaves[:first] for x in leaf]
            after = [x for leaf in self.leaves[stop + 1 :] for x in leaf]
            self._build(before + merged + after)
            return
        # over the leaves from first to stop, evenly
        n = stop - first + 1
        for i in range(n):
            self._put(first + i, merged[len(merged) * i // n : len(merged) * (i + 1) // n])


EDITED = "n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long"


def edited_counts(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, edits_of=None) -> DataFrame:
    """The id and EDITED of every text: token counts before and after its edits, and how many pre-tokens the edits encoded.

    Edits are an array of (start, end, replacement) in `edits_col`, or what `edits_of`(id, text) returns; they apply in
    order.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    cols = [id_col, text_col] + ([edits_col] if edits_col else [])

    def make():
        coder = ByteBPE(ranks.value, pattern)

        def run(part: pa.RecordBatch) -> dict:
            names = [x.split()[0] for x in EDITED.split(", ")]
            out: dict = {c: [] for c in names}
            given = part.column(2).to_pylist() if edits_col else [None] * part.num_rows
            texts = [t or "" for t in part.column(1).to_pylist()]
            split = [coder.split.findall(t) for t in texts]
            coder.learn(set(chain.from_iterable(split)))
            parts = [counted(coder, words) for words in split]
            del split
            for key, text, own, known in zip(part.column(0).to_pylist(), texts, given, parts):
                tree = TokenTree(coder, text, known)
                edits = [tuple(x.values()) for x in own or ()] if edits_col else list(edits_of(key, text))
                before = (sum(map(len, tree.leaves)), tree.n_tokens)
                for e in edits:
                    tree.edit(*e)
                for c, v in zip(names, (*before, len(edits), tree.encoded, tree.n_tokens)):
                    out[c].append(v)
            return {id_col: part.column(0)} | out

        return run

    return map_slices(df, cols, text_col, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {EDITED}", make)
