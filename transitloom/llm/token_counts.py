"""Token counts (operator 4): a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest vocabulary entry that begins what is left of a
word.  The automaton is a trie of the vocabulary whose nodes carry a failure link and the number of pieces popped on
following it, both computed once, so that counting a word's pieces takes one step for each byte and builds no piece.

A word is a maximal run of bytes other than white space (0x20, 0x09-0x0D); pieces that begin a word carry the
vocabulary's word mark (the leading space of a byte-level vocabulary), which is matched before the word's bytes.  A word
that the vocabulary can't build counts as one token, the unknown token of word pieces; a vocabulary that holds all
single bytes has no such word.

Null and empty texts have no words and no tokens; repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from transitloom.llm._text import NOT_SPACE, Text, chunks
from transitloom.llm.token_ids import default_path

MARK = b" "
COUNTS = "doc_id long, n_words long, n_tokens long, longest_word long"
#: Distinct words whose counts a worker remembers; when reached, it forgets them all.
REMEMBERED = 300_000


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        entry = [False]
        for piece in vocabulary:
            at = 0
            for b in piece:
                at = children[at].setdefault(b, len(children))
                if at == len(children):
                    children.append({})
                    entry.append(False)
            entry[at] = True
        fail, popped = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:  # breadth first: links lead to shallower nodes, which are ready
            after = []
            for parent in level:
                for b, v in children[parent].items():
                    if entry[v]:
                        fail[v], popped[v] = 0, 1
                    else:
                        z, n = fail[parent], popped[parent]
                        while z != -1 and b not in children[z]:
                            n += popped[z]
                            z = fail[z]
                        if z != -1:
                            fail[v], popped[v] = children[z][b], n
                    after.append(v)
            level = after
        self.children, self.fail, self.popped = children, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy tokenisation of `word`; -1 if it has none."""
        children, fail, popped = self.children, self.fail, self.popped
        at = n = 0
        for b in word:
            while (to := children[at].get(b)) is None:
                if fail[at] == -1:
                    return -1
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] == -1:
                return -1
            n += popped[at]
            at = fail[at]
        return n


@functools.lru_cache(maxsize=2)
def automaton(path: str | None) -> LongestMatch:
    return LongestMatch(read_vocabulary(path or default_path("byte_bpe_50k.tiktoken")))


def token_counts(docs: DataFrame, vocabulary: str | None = None, mark: bytes = MARK) -> DataFrame:
    """doc_id, n_words, n_tokens and longest_word (the most tokens of one word) of each row of `docs`."""

    def run(batches):
        machine, known = automaton(vocabulary), {}
        for batch in batches:
            for part in chunks(batch, "text"):
                text = Text(part.column("text"))
                words = text.words(NOT_SPACE)
                _, where, which = np.unique(words.hash, return_index=True, return_inverse=True)
                if len(known) > REMEMBERED:
                    known.clear()
                counts = np.empty(len(where), np.int64)
                for i, (s, e) in enumerate(zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)):
                    w = words.data[s:e].tobytes()
                    if (n := known.get(w)) is None:
                        n = machine.count(mark + w)
                        n = known[w] = 1 if n < 0 else n
                    counts[i] = n
                per_word = counts[which]
                sums = np.concatenate([[0], np.cumsum(per_word)])
                total = sums[words.first[1:]] - sums[words.first[:-1]]
                most = np.zeros(text.n, np.int64)
                np.maximum.at(most, words.doc(), per_word)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(words.counts), pa.array(total), pa.array(most)], names=["doc_id", "n_words", "n_tokens", "longest_word"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTS)
