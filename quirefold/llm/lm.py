"""Language-model scores from a weighted backoff automaton.

Smoothed bigrams are the automaton: a state for each known word, an arc for each bigram seen in
training, and a failure arc from each state to the root, whose arcs are the single words.
Weights are log10 of Dirichlet-smoothed probabilities: P(v) = (c(v) + 1) / (N + V + 1) and
P(v | u) = (c(uv) + K * P(v)) / (c(u) + K), so the failure arc of u weighs
K / (c(u) + K) and both sum to 1 over the known words and one unknown. A text is
one walk from the start state to the end token, which carries the state and adds up weights.

Counts are those of all training documents, whatever their number: blocks.py adds
them up, and each block builds the part of the automaton that its texts can reach.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.llm.blocks import corpus_counts, in_blocks, reply, slices_for, stats, with_replies
from quirefold.llm.common import BLANK_WORDS, Words, binaries, distinct, distinct_counts, mix, places, raw_text, runs, sweep

K = 50.0
#: Tokens that a lane of the walk reads.
LANE = 64
U64 = np.uint64
#: The end token's key; the start state is the state after an end.
END = U64(0x5DEECE66D1234566)
ODD = U64(1)
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after each text, and the number of tokens of each text."""
    parts, sizes = [], []
    for lo, hi in runs(texts):
        w = Words(texts[lo:hi], BLANK_WORDS)
        n = np.diff(w.first) + 1
        seq = np.full(int(n.sum()), END, U64)
        word = np.ones(len(seq), bool)
        word[np.cumsum(n) - 1] = False
        seq[word] = w.hash & ~ODD
        parts.append(seq)
        sizes.append(n)
    return np.concatenate(parts or [np.empty(0, U64)]), np.concatenate(sizes or [np.empty(0, np.int64)])


def bigrams(seq: np.ndarray) -> np.ndarray:
    """The key of each token with the one before; before a text stands an end."""
    before = np.concatenate([[END], seq[:-1]]) if len(seq) else seq
    return mix(before * U64(0x9E3779B97F4A7C15) + seq) | ODD


def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block, words even and bigrams odd, with their training counts."""
    seq, sizes = tokens(binaries(table["raw"]))
    learn = np.repeat(~np.asarray(table["held_out"]), sizes)
    two = bigrams(seq)
    keys = distinct(np.concatenate([seq, two]))
    known, n = distinct_counts(np.concatenate([seq[learn], two[learn]]))
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, known)] = n
    return keys, counts


class Automaton:
    """The states and arcs that a block's texts can reach.

    State 0 is the root; the others are the words after which training texts went on (and the end token,
    after which a text starts), ascending by key. An arc leads from a state over a word to
    that word's state, or to the root if training knows nothing after it. The root has an arc for
    every word, and one for the unknown. From each other state a failure arc leads to the root.
    """

    def __init__(self, seq: np.ndarray, keys: np.ndarray, totals: np.ndarray, n_train: int, n_types: int, k: float = K):
        count = lambda x: totals[places(keys, x)]
        self.words = distinct(np.append(seq, END))
        self.seen = count(self.words) if len(keys) else np.zeros(len(self.words), np.int64)
        root = (self.seen + 1.0) / (n_train + n_types + 1)
        self.root = np.log10(root)
        known = self.seen > 0
        self.state_of = np.where(known, np.cumsum(known), 0).astype(np.int32)  # by word; 0 is the root
        self.start = int(self.state_of[np.searchsorted(self.words, END)])
        n = self.seen[known]
        self.fail = np.concatenate([[0.0], np.log10(k / (n + k))])
        # arcs: the bigrams of the block's texts that training has, by state and word
        label = places(self.words, seq).astype(np.int64)
        before = np.concatenate([[np.searchsorted(self.words, END)], label[:-1]]) if len(seq) else label
        pair, at = np.unique(before << 32 | label, return_index=True)
        arc = count(bigrams(seq)[at]) if len(seq) else np.empty(0, np.int64)
        has = arc > 0
        u, v = pair[has] >> 32, pair[has] & 0xFFFFFFFF
        self.arcs = self.state_of[u].astype(np.int64) << 32 | v
        self.weight = np.log10((arc[has] + k * root[v]) / (self.seen[u] + k))
        self.label = label

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights of the arcs taken, failure arcs included."""
        want = state.astype(np.int64) << 32 | label
        at = np.minimum(places(self.arcs, want), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(want), np.int64)
        found = self.arcs[at] == want if len(self.arcs) else np.zeros(len(want), bool)
        weight = self.fail[state] + self.root[label]
        weight[found] = self.weight[at[found]]
        return self.state_of[label], weight

    def walk(self) -> np.ndarray:
        """The weight of each token, texts read from left to right with the state carried on.

        The tokens are read in lanes of LANE at a time. A lane that starts inside a text has the state
        to which the token before it leads, as every state has one word; after an end that
        is the start state.
        """
        n, out = len(self.label), np.empty(len(self.label))
        at = np.arange(0, n, LANE)
        state = np.concatenate([[self.start], self.state_of[self.label[at[1:] - 1]]]).astype(np.int32) if n else at
        for t in range(min(LANE, n)):
            live = at + t < n
            at, state = at[live], state[live]
            state, out[at + t] = self.step(state, self.label[at + t])
        return out


def score(docs: DataFrame, k: float = K) -> DataFrame:
    """docs (doc_id, held_out, text) → doc_id, held_out and SCORES.

    Learns from rows with held_out false. Null texts count as empty: one end token. Without
    training rows each token has the root's weight with N = V = 0. Repeated rows are scored each;
    a long text is a block of its own and is scored whole. An empty table gives no rows.
    """
    blocks = in_blocks(docs.select("doc_id", "held_out", raw_text().alias("raw")))
    counts = corpus_counts(blocks, keys_of, slices_for(blocks))
    s = stats(counts)
    sweep(docs.sparkSession)
    n_train, n_types = s.even_total, s.even

    def use(_, table, answers):
        seq, sizes = tokens(binaries(table["raw"]))
        keys = distinct(np.concatenate([seq, bigrams(seq)]))
        machine = Automaton(seq, keys, reply(answers), n_train, n_types, k)
        c, root, weight = machine.seen[machine.label], machine.root[machine.label], machine.walk()
        at = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, at) if len(at) else np.empty(0)
        cols = [
            table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(sizes), pa.array(add((c > 0).astype(np.int64)), pa.int64()),
            pa.array(np.full(len(at), n_train, np.int64)), pa.array(add(root), pa.float64()), pa.array(add(weight), pa.float64()),
        ]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_replies(blocks, counts.where("block >= 0").select("block", "slice", "totals"), use, f"doc_id long, held_out boolean, {SCORES}")
