"""Language-model scores from a weighted backoff automaton that is never in one place.

The model is an n-gram model over words with Dirichlet smoothing: for a history h,
its own shorter history h' and a token w,

    P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m),   P(w) = (c(w) + a) / (N + a (V + 1))

As an automaton, a state is a history that training text holds. A seen n-gram is an
arc with weight log10 P(w | h) to the state of its own longest history; from any other
token a failure arc of weight log10(m / (c(h) + m)) leads to the state of h', and the
empty history has an arc for every token. A text is read once from left to right: the
state is carried from token to token, failure arcs are followed until an arc fits, and
weights add up. Each history's probabilities sum to 1 over the V tokens and one unknown.

The automaton grows with the corpus, so it's not broadcast. Counts of n-grams are
gathered over all training text by :mod:`.blocks`, and each block of texts is sent
the counts of its own n-grams: from them it builds the part of the automaton that its
texts can enter, and walks it. Texts are walked side by side, a token of each at a time;
a long one is walked in stretches, each of which begins in the empty state a few tokens
early: after as many tokens as the longest history has, the state is the same.

An n-gram of three tokens or more goes to the exchange only if each pair of neighbours in
it stands twice or more in all texts: one that holds a pair of a single place stands
there alone itself, so its count is known without asking.

Single tokens are told apart by 58 bits of hash, so V, N and their counts are exact up
to collisions of these, longer n-grams by 46 bits.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, COUNT_BITS, FILTER_BITS, SENT, TASKS, Sizes, _send, answer, deal, finish, groups, measure, pack, send, send_again, short, spread, tally, unpack, unpack_keys
from .memory import trim
from .words import mix, words

_U = np.uint64
END, BEGIN = _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)
#: Added to each token's count; weight of the shorter history, in tokens; tokens of the longest n-gram; tokens of a stretch.
ADD, SHORTER, ORDER, STRETCH = 0.1, 4.0, 3, 256


def _tokens(texts: pa.ChunkedArray, order: int, size: int | None = None):
    """By segment: text of each token, a hash of the n-gram of each length that ends there, and which of them exist.

    A text's tokens are its lower-cased words and one end. A history reaches back to
    one mark of the text's beginning, which is no token.
    """
    for w in words(texts, lower=True, size=size):
        n = w.counts() + 1
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(w.n_docs), n)
        token = np.full(int(ends[-1]), END, _U)
        token[np.arange(len(w.hash)) + (w.doc - w.first)] = w.hash
        since = np.arange(len(token)) - (ends - n)[doc]  # tokens before this one in its text
        grams, exist = [mix(token)], [np.ones(len(token), bool)]
        for k in range(2, order + 1):
            before = np.full(len(token), BEGIN, _U) if k == 2 else np.zeros(len(token), _U)
            ok = since >= k - 2
            inside = since >= (1 if k == 2 else k - 2)
            at = np.flatnonzero(inside & (np.arange(len(token)) > 0))
            before[at] = grams[-1][at - 1]
            grams.append(mix(before * _U(0xD6E8FEB86659FD93) + token))
            exist.append(ok)
        yield w.first, w.n_docs, doc, n, grams, exist


def _totals(docs: DataFrame, sizes: Sizes) -> tuple[int, int]:
    """Tokens of the training text, and how many different ones."""
    sizes = replace(sizes, bits=(COUNT_BITS,), group=0, batch=0)

    def run(batches):
        for batch in batches:
            for _, _, _, _, grams, _ in _tokens(pa.chunked_array([batch.column(0)]), 1, 4 << 20):
                k, n, _ = tally(short(grams[0]), np.zeros(len(grams[0]), bool))
                yield from _send(0, [(k, [n.astype(_U)])], sizes).to_batches()
        trim()

    def count(table: pa.Table) -> pa.Table:
        ks, total = [], 0
        for data in table.column("payload"):
            data = data.as_buffer().to_pybytes()
            k, end = unpack_keys(data)
            ks.append(k)
            total += int(unpack(data, end)[0].sum())
        kinds = len(np.unique(np.concatenate(ks)))
        trim()
        return pa.table({"tokens": pa.array([total], pa.int64()), "kinds": pa.array([kinds], pa.int64())})

    sent = docs.where("not held_out").select("text").mapInArrow(run, SENT)
    each = sent.repartition(min(TASKS, sizes.parts), "__part").groupBy("__part").applyInArrow(count, "tokens long, kinds long")
    row = each.agg(F.sum("tokens"), F.sum("kinds")).first()
    return row[0] or 0, row[1] or 0


class Grams:
    """The n-grams of a block of texts, by segment, and their keys."""

    def __init__(self, table: pa.Table, order: int):
        self.segments = list(_tokens(table.column("text"), order))
        held = table.column("held_out").to_numpy(zero_copy_only=False)
        self.held = [held[first + doc] for first, _, doc, _, _, _ in self.segments]

    def every(self, m: int, only: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of m + 1 tokens, and whether they are held out. only: which of them, by segment."""
        ks, out = [np.empty(0, _U)], [np.empty(0, bool)]
        for i, (_, _, _, _, grams, exist) in enumerate(self.segments):
            e = exist[m] if only is None else only[i]
            ks.append(short(grams[m][e], FILTER_BITS if m else COUNT_BITS))
            out.append(self.held[i][e])
        return np.concatenate(ks), np.concatenate(out)

    def split(self, m: int, values: np.ndarray, other, only: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Values of the n-grams of every, by segment at the tokens where they end; other where there's none."""
        out, seen = [], 0
        for i, (_, _, doc, _, _, exist) in enumerate(self.segments):
            e = exist[m] if only is None else only[i]
            v = np.full(len(doc), other, values.dtype)
            v[e] = values[seen : seen + int(e.sum())]
            seen += int(e.sum())
            out.append(v)
        return out

    def asked(self, m: int, again: list[np.ndarray]) -> list[np.ndarray]:
        """Which n-grams of m + 1 tokens, three or more, may stand elsewhere. again: by segment, of which tokens the pair that ends there stands twice."""
        out = []
        for (_, _, _, _, _, exist), pair in zip(self.segments, again):
            ok = exist[m].copy()
            for back in range(m):
                ok[back:] &= pair[: len(pair) - back]
                ok[:back] = False
            out.append(ok)
        return out


class Automaton:
    """The states and arcs of one segment of texts.

    arc[m]: of each token of the segment, the number of the arc of the n-gram of m + 1
    tokens that ends there; -1 if training text doesn't hold it. Single tokens always
    have one. An arc has a weight and the state it leads to; a state has its level (the
    tokens of its history), the weight of its failure arc and the state that leads to.
    State 0 is the empty history, whose failure arc isn't followed; state 1 the text's beginning.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], starts: np.ndarray, total: int, kinds: int, texts: int):
        """grams, counts: by length, of the n-gram that ends at each token, the count 0 for one that reaches over the text's beginning. starts: first tokens of texts."""
        order = len(grams)
        begins = np.zeros(len(grams[0]), bool)
        begins[starts] = True
        self.level, self.fail, self.fail_weight = [np.array([0, 1 if texts else 0])], [np.zeros(2, np.int64)], [np.array([0.0, np.log10(SHORTER / (texts + SHORTER))])]
        self.arc, self.weight, self.to = [], [], []
        n_arcs, n_states = 0, 2
        state = np.zeros(len(grams[0]), np.int64)  # of each token, that of the longest history known so far that ends with it
        lower = floor = None  # probability of each token after the history one shorter
        self.begin = 1 if order > 1 and texts else 0
        for m in range(order):
            seen = np.flatnonzero(counts[m] > 0) if m else np.arange(len(grams[m]))
            _, rep, number = np.unique(grams[m][seen], return_index=True, return_inverse=True)
            rep = seen[rep]
            c = counts[m][rep].astype(float)
            if not m:
                floor = total + ADD * (kinds + 1)
                p = (c + ADD) / floor
            else:
                before = np.where(begins[rep], texts if m == 1 else 0, np.concatenate([[0], counts[m - 1][:-1]])[rep])
                p = (c + SHORTER * lower[rep]) / (before + SHORTER)
            arc = np.full(len(grams[m]), -1)
            arc[seen] = n_arcs + number
            self.arc.append(arc)
            self.weight.append(np.log10(p))
            # probabilities of all tokens at this length, for the next one
            if not m:
                lower = p[number]
            else:
                history = np.where(begins, texts if m == 1 else 0, np.concatenate([[0], counts[m - 1][:-1]]))
                known = (history > 0) & (counts[m] >= 0)
                lower = np.where(known, (np.maximum(counts[m], 0) + SHORTER * lower) / (history + SHORTER), lower)
            # an n-gram that training text holds is a history too, if a longer one may follow
            shorter = state[rep]
            if m < order - 1:
                is_state = c > 0
                own = np.where(is_state, n_states + np.cumsum(is_state) - 1, shorter)
                self.level.append(np.full(int(is_state.sum()), m + 1))
                self.fail.append(shorter[is_state])
                self.fail_weight.append(np.log10(SHORTER / (c[is_state] + SHORTER)))
                n_states += int(is_state.sum())
                state = state.copy()
                state[seen] = own[number]
            self.to.append(state[rep])
            n_arcs += len(rep)
        # an arc leads to the longest history that its n-gram's end makes
        self.level, self.fail, self.fail_weight = (np.concatenate(x) for x in (self.level, self.fail, self.fail_weight))
        self.weight, self.to = np.concatenate(self.weight), np.concatenate(self.to)

    def walk(self, token: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a token in each of several states: weights, and the next states."""
        weight = np.zeros(len(token))
        arc = np.full(len(token), -1)
        lost = np.arange(len(token))
        while len(lost):
            level = self.level[state[lost]]
            found = np.empty(len(lost), np.int64)
            for m, arcs in enumerate(self.arc):
                at = level == m
                found[at] = arcs[token[lost[at]]]
            arc[lost] = found
            lost = lost[found < 0]
            weight[lost] += self.fail_weight[state[lost]]
            state = state.copy()
            state[lost] = self.fail[state[lost]]
        return weight + self.weight[arc], self.to[arc]


def traverse(a: Automaton, n: np.ndarray, order: int, stretch: int = STRETCH) -> np.ndarray:
    """Sum of weights of each text of a segment; n: tokens of each, one after the other."""
    heads = np.cumsum(n) - n
    pieces = -(-n // stretch)
    text = np.repeat(np.arange(len(n)), pieces)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = heads[text] + inner * stretch
    end = np.minimum(first + stretch, heads[text] + n[text])
    # stretches within a text begin early, from the empty state
    at = np.maximum(first - (order - 1) * (inner > 0), heads[text])
    begins = at == heads[text]
    state = np.where(begins, a.begin, 0)
    sums = np.zeros(len(text))
    by_length = np.argsort(at - end, kind="stable")  # longest first
    at, end, first, state, of = at[by_length], end[by_length], first[by_length], state[by_length], text[by_length]
    live = len(at)
    step, length = 0, end - at
    while live:
        live = int(np.searchsorted(-length, -step, "left"))  # those longer than step
        if not live:
            break
        weight, state[:live] = a.walk(at[:live] + step, state[:live])
        sums[:live] += np.where(at[:live] + step >= first[:live], weight, 0.0)
        step += 1
    return np.bincount(of, weights=sums, minlength=len(n))


def lm_score(docs: DataFrame, id_: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = 10, fold: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    A row is held out of training where crc32 of its id as text modulo ``folds`` is
    ``fold``. base_score sums log10 of the smoothed frequencies of the tokens alone,
    score is the automaton's log10 probability of the text, its end included.

    * A null or wordless text is a text of one token, its end. A null id counts as ''.
    * Repeated rows count as often as they stand. Without training rows all counts
      are 0: no token is known, and each costs log10 of 1 (a single unknown).
    * An empty table gives an empty table; further columns of docs are not read.
    """
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    rows = rows.withColumn("held_out", held)
    sizes = measure(rows, "text", block_bytes, *(COUNT_BITS, FILTER_BITS)[:order])
    then = replace(sizes, bits=(FILTER_BITS,) * max(1, order - 2))
    tokens, kinds = _totals(rows, sizes)
    texts = rows.where("not held_out").count()
    dealt = deal(rows, "doc_id", "text", sizes)
    few, long_ = range(min(order, 2)), range(2, order)

    def counted(keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        k, n, out = tally(*keys)
        return k, [(n - out).astype(_U), out.astype(_U)]

    def keys(table: pa.Table):
        g = Grams(table, len(few))
        return [counted(g.every(m)) for m in few]

    def reply(k, _, values):
        """How often a key stands in training text, and whether it stands twice in any."""
        by, at, size = groups(k)
        train = np.add.reduceat(values[0][by], at)
        twice = train + np.add.reduceat(values[1][by], at) > 1
        return [spread(by, size, train), spread(by, size, twice.astype(_U))]

    def first_counts(g: Grams, got: list[np.ndarray]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        """Training counts by length and segment, and by segment which pairs stand twice."""
        seen, counts, pairs = 0, [], []
        for m in few:
            by, at, size = groups(g.every(m)[0])
            counts.append(g.split(m, spread(by, size, got[0][seen : seen + len(at)]).astype(np.int64), -1))
            if m:
                pairs = g.split(m, spread(by, size, got[1][seen : seen + len(at)]) > 0, False)
            seen += len(at)
        return counts, pairs

    def again(table: pa.Table, got: list[np.ndarray]):
        g = Grams(table, order)
        _, pairs = first_counts(g, got)
        found = [counted(g.every(m, g.asked(m, pairs))) for m in long_]
        return [(k, v[:1]) for k, v in found] or [(np.empty(0, _U), [])], pack(*got)

    def reply_again(k, _, values):
        by, at, size = groups(k)
        return [spread(by, size, np.add.reduceat(values[0][by], at))]

    def end(table: pa.Table, got: list[np.ndarray], own: bytes) -> pa.Table:
        g = Grams(table, order)
        counts, pairs = first_counts(g, unpack(own))
        seen = 0
        for m in long_:
            asked = g.asked(m, pairs)
            by, at, size = groups(g.every(m, asked)[0])
            known = g.split(m, spread(by, size, got[0][seen : seen + len(at)]).astype(np.int64) if len(at) else np.empty(0, np.int64), -1, asked)
            seen += len(at)
            # those that weren't asked for stand here alone
            counts.append([np.where(a, c, np.where(s[5][m], ~h, -1)) for a, c, s, h in zip(asked, known, g.segments, g.held)])
        result = []
        for i, (_, n_docs, doc, n, grams, _) in enumerate(g.segments):
            c = [x[i] for x in counts]
            a = Automaton(grams, c, np.cumsum(n) - n, tokens, kinds, texts)
            base = np.log10((c[0] + ADD) / (tokens + ADD * (kinds + 1)))
            add = [np.bincount(doc, weights=x, minlength=n_docs) for x in ((c[0] > 0).astype(float), base)]
            result.append((n, *add, traverse(a, n, order)))
        n, known, base, score = (np.concatenate(x) for x in zip(*result))
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.round(known).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    answered = answer(send(dealt, keys, sizes), reply, sizes)
    answered = answer(send_again(dealt, answered, again, sizes, then), reply_again, then)
    return finish(dealt, answered, end, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", then, noted=True)
