"""Token counts by trie-shared dynamic programming under a unigram model over the pieces of a rank file.

The distinct pre-tokens of a run of documents go into a trie; the best forward cost of a prefix is computed once, at its trie node,
for all words that share it, and words keep the token count of their terminal node. Nodes are told apart by their bytes: words are
sorted, so the words below a node stand together. Pieces that end at a node are found by walking back from it through a trie of the
reversed pieces. Costs are whole numbers, so ties are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from breakwater.llm.pretokens import read_ranks, with_pretokens, word_slices
from breakwater.llm.textvec import utf8

RUN = 2_000_000
#: Words whose counts a task keeps between runs; beyond that it starts anew.
KNOWN = 1 << 20
_NONE = np.int64(1) << np.int64(60)


def piece_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Each piece's cost -4096 ln p, with p falling as 1 / (rank + 2.7)."""
    total = sum(1 / (r + 2.7) for r in ranks.values())
    return {piece: round(4096 * math.log((r + 2.7) * total)) for piece, r in ranks.items()}


class Pieces:
    """The reversed pieces as a trie: states by depth, steps from the root and its 256 children in a table, others in sorted order."""

    def __init__(self, costs: dict[bytes, int]):
        self.longest = max(map(len, costs))
        steps: dict[tuple[int, int], int] = {}
        state = {b"": 0}
        for size in range(1, self.longest + 1):
            for tail in sorted({p[-size:] for p in costs if len(p) >= size}):
                state[tail] = steps[state[tail[1:]], tail[0]] = len(state)
        self.cost = np.full(len(state), _NONE, np.int64)
        for piece, cost in costs.items():
            self.cost[state[piece]] = cost
        keys = np.array([s << 8 | b for s, b in steps], np.int64)
        by = np.argsort(keys)
        self.keys, self.next = keys[by], np.fromiter(steps.values(), np.int32, len(steps))[by]
        self.near = np.full(257 << 8, -1, np.int32)
        low = self.keys < len(self.near)
        self.near[self.keys[low]] = self.next[low]

    def step(self, state: np.ndarray, byte: np.ndarray, back: int) -> np.ndarray:
        """The states one byte further back, -1 where there is none; ``back`` is how many bytes that makes."""
        key = state.astype(np.int64) << 8 | byte
        if back <= 2:
            return self.near[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


def trie_forward(words: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """Token count and cost of each distinct word, and the number of trie nodes. Among equal costs the fewest tokens win."""
    order = pc.sort_indices(words).to_numpy()
    raw, at = utf8(words.take(pa.array(order)))
    starts, sizes = at[:-1], np.diff(at)
    counts, costs, nodes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    alive = np.flatnonzero(sizes > 0)
    node = np.zeros(len(alive), np.int64)
    #: Of each depth that a piece can reach back to: the nodes' parents, costs and token counts.
    levels = {0: (None, np.zeros(1, np.int64), np.zeros(1, np.int64))}
    depth = 0
    while len(alive):
        depth += 1
        byte = raw[starts[alive] + (depth - 1)]
        head = np.ones(len(alive), bool)
        head[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        first = np.flatnonzero(head)
        parent, end = node[first], starts[alive[first]] + depth
        node = np.cumsum(head) - 1
        cost, count = np.full(len(first), _NONE), np.zeros(len(first), np.int64)
        who, above, state = np.arange(len(first)), parent, np.zeros(len(first), np.int32)
        for back in range(1, min(depth, pieces.longest) + 1):
            state = pieces.step(state, raw[end[who] - back], back)
            found = state >= 0
            who, above, state = who[found], above[found], state[found]
            if not len(who):
                break
            grand, their_cost, their_count = levels[depth - back]
            last = np.flatnonzero(pieces.cost[state] < _NONE)
            own, of = who[last], above[last]
            total, tokens = their_cost[of] + pieces.cost[state[last]], their_count[of] + 1
            better = (total < cost[own]) | ((total == cost[own]) & (tokens < count[own]))
            cost[own[better]], count[own[better]] = total[better], tokens[better]
            if back < depth:
                above = grand[above]
        levels[depth] = (parent, cost, count)
        levels.pop(depth - pieces.longest, None)
        nodes += len(first)
        done = sizes[alive] == depth
        counts[order[alive[done]]], costs[order[alive[done]]] = count[node[done]], cost[node[done]]
        alive, node = alive[~done], node[~done]
    return counts, costs, nodes


def token_counts(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", most_known: int = KNOWN) -> DataFrame:
    """Count the tokens of each whole text: ``doc_id, n_pretokens, n_tokens, cost`` (of the best segmentation, -4096 ln p).

    A null or empty text has none. Repeated rows give equal rows; ties take the fewest tokens; other columns are left out. A word's
    length is not limited: a long one is a long branch of the trie. ``most_known`` bounds a task's memory and changes no result.
    """
    ranks = read_ranks(path)
    if missing := [x for x in range(256) if bytes([x]) not in ranks]:
        raise ValueError(f"{path} lacks single bytes {missing[:5]}")
    pieces = Pieces(piece_costs(ranks))
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("cost", pa.int64())])

    def count(batches):
        known, known_counts, known_costs = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ids, at, words in word_slices(batches, RUN):
            coded = words.dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary())
            place = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            new = np.flatnonzero(place < 0)
            if len(known) + len(new) > most_known:
                known, known_counts, known_costs = known[:0], known_counts[:0], known_costs[:0]
                new = np.arange(len(distinct))
            if len(new):
                asked = distinct.take(pa.array(new))
                got = trie_forward(asked, pieces)
                place[new] = len(known) + np.arange(len(new))
                known = pa.concat_arrays([known, asked])
                known_counts, known_costs = np.concatenate([known_counts, got[0]]), np.concatenate([known_costs, got[1]])
            which = np.asarray(coded.indices)
            sums = [np.concatenate([[0], np.cumsum(x[place][which])]) for x in (known_counts, known_costs)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(at)), *(pa.array(np.diff(s[at])) for s in sums)], schema=schema)

    return with_pretokens(docs, id_col, text_col, pattern).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long, cost long")
