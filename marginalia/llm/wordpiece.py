"""Token counts by greedy longest match, in one pass over each word.

The automaton is a trie of the vocabulary with failure links. Following a node's failure link means to
take the longest pieces off the front of what has been matched; how many they are is stored with the
node, so the number of pieces of a word is a sum over the failures met, and no piece is ever built. Each
byte is read once and each failure shortens what is matched, so a word takes time linear in its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import slices
from marginalia.llm.packing import _byte_of_char

_KEEP = 400_000  # words whose counts a worker remembers
_KEEP_BYTES = 64  # of a word that is remembered
_START, _INSIDE = 0, 1  # roots of the pieces that begin a word and of those that continue one


class Automaton:
    """Counts the pieces of words. A word whose greedy match fails is one unknown token."""

    def __init__(self, first: Iterable[bytes], inside: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((_START, first), (_INSIDE, inside)):
            for piece in pieces:
                node = root
                for byte in piece:
                    to = self.next[node].get(byte)
                    if to is None:
                        to = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = to
                if piece:
                    final[node] = True
        # fail: where matching goes on once pieces are taken off, or -1; popped: how many are taken
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [_START, _INSIDE]
        while level:
            below = []
            for node in level:
                for byte, to in self.next[node].items():
                    below.append(to)
                    if final[to]:
                        self.fail[to], self.popped[to] = _INSIDE, 1
                        continue
                    at, taken = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.next[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[to], self.popped[to] = self.next[at][byte], taken
            level = below
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it has no greedy match."""
        node, pieces = _START, 0
        step, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            to = step[node].get(byte)
            while to is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = step[node].get(byte)
            node = to
        while node != _INSIDE:
            pieces += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return pieces

    def counts(self, words: list[bytes]) -> list[int]:
        """count() of each word; a bounded number of words is remembered."""
        known = self.known
        if len(known) > _KEEP:
            known.clear()
        fresh = {w: self.count(w) for w in words if w not in known}
        known.update((w, n) for w, n in fresh.items() if len(w) <= _KEEP_BYTES)
        return [known[w] if w in known else fresh[w] for w in words]


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file: pieces that begin with a space begin words, the
    others continue them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, special = _byte_of_char(), {t["content"] for t in spec["added_tokens"]}
    tokens = [bytes(chars[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return Automaton([t[1:] for t in tokens if t.startswith(b" ") and len(t) > 1], [t for t in tokens if not t.startswith(b" ")])


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_words, n_tokens and n_unknown (long; columns of these names are replaced) for each row's
    whole text: words end at white space (x20, x09-x0D), each is matched greedily, longest piece first,
    and one that fails counts as one unknown token. Null and empty texts have none of each. Rows are
    counted one by one, so repeated rows and null ids make no difference; an empty table gives no rows."""
    new = ["n_words", "n_tokens", "n_unknown"]
    docs = docs.select([c for c in docs.columns if c not in new])
    names = docs.columns
    place = names.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{c} bigint" for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(path)
        for batch in slices(batches):
            rows = []
            for t in batch.column(place).to_pylist():
                pieces = automaton.counts((t or "").encode("utf-8", "surrogatepass").split())
                unknown = pieces.count(0)
                rows.append((len(pieces), sum(pieces) + unknown, unknown))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names + new)

    return docs.mapInArrow(run, schema)
