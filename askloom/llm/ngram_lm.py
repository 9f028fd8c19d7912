"""Language-model scores by a weighted backoff automaton.

The model is an interpolated bigram model with absolute discounting. As an
automaton its states are the words that were followed by something (and the start
of a text); an arc for each bigram seen carries its log-probability, and a failure
arc carries the weight of falling back to the single word. A text is one walk from
left to right: at each token take the arc of the state, or fail and pay for it,
then move to the token's state.

No machine holds the automaton. Each block of documents asks the hash slices for
the counts of the n-grams that it walks over, so what is gathered is the part of
the automaton that its own texts need. Counts cover all training documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askloom.llm.common import (
    Layout,
    answer,
    ask,
    ask_again,
    block_words,
    blocked,
    by_slice,
    finish,
    join_parts,
    merged,
    mix,
    pack,
    pack_any,
    split_parts,
    text_bytes,
    unpack,
    unpack_any,
)

FOLDS = 10
#: Added to every count by the base model.
BASE = 0.1
_START, _STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
_UNI, _BI, _HISTORY = (np.uint64(k) for k in (0x51, 0x52, 0x53))


def remainder(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``; -1 without an id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


class Walk:
    """The tokens of a block: words in lower case A-Z and an end per document,
    documents end to end, with the keys of their n-grams."""

    def __init__(self, docs: pa.Table, folds: int):
        words, counts = block_words(docs, lower=True)
        self.n_tokens = counts + 1
        ends = np.cumsum(self.n_tokens)
        tokens = np.empty(int(ends[-1]), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends - 1] = True
        tokens[~is_end], tokens[is_end] = mix(words), _STOP
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[ends - self.n_tokens] = _START
        self.first = ends - self.n_tokens
        rest = np.array([remainder(i, folds) for i in docs.column("doc_id").to_pylist()])
        self.held_out = rest == 0
        self.trains = np.repeat(rest > 0, self.n_tokens)
        self.word = mix(tokens + _UNI)
        self.pair = mix(mix(before + _BI) * np.uint64(3) + tokens)
        self.history = mix(before + _HISTORY)
        # Unigrams and bigrams are asked for together.
        self.keys, back = np.unique(np.concatenate([self.word, self.pair]), return_inverse=True)
        self.word_at, self.pair_at = back[: len(tokens)], back[len(tokens) :]
        self.states, self.state_at = np.unique(self.history, return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training occurrences of each key, and which keys are bigrams."""
        n = np.bincount(self.word_at[self.trains], minlength=len(self.keys))
        n += np.bincount(self.pair_at[self.trains], minlength=len(self.keys))
        is_pair = np.zeros(len(self.keys), bool)
        is_pair[self.pair_at] = True
        return n, is_pair

    def leaving(self, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state: training tokens after it in this block, and bigrams
        after it that this block is the one to count."""
        tokens = np.bincount(self.state_at[self.trains], minlength=len(self.states))
        _, once = np.unique(self.pair_at, return_index=True)
        kinds = np.bincount(
            self.state_at[once], owned[self.pair_at[once]], minlength=len(self.states)
        ).astype(np.int64)
        return tokens, kinds


class Totals:
    """Corpus figures: training tokens and distinct tokens, and the discounts of
    single words and of bigrams."""

    def __init__(self, sums: np.ndarray):
        self.tokens, self.types, once, twice, pair_once, pair_twice = sums.tolist()
        self.discount = discount(once, twice)
        self.pair_discount = discount(pair_once, pair_twice)


def discount(once: int, twice: int) -> float:
    """Taken off each count, from how many n-grams occur once and twice."""
    return min(0.98, max(0.1, once / (once + 2 * twice))) if once else 0.5


def single(count: np.ndarray, totals: Totals) -> np.ndarray:
    """Probability of a word by itself. All words that training never saw share
    what the discount took off the others."""
    if not totals.tokens:
        return np.ones(len(count))
    unseen = totals.discount * totals.types / totals.tokens
    return np.where(count > 0, (count - totals.discount) / totals.tokens, unseen)


def arcs(pair: np.ndarray, after: np.ndarray, kinds: np.ndarray, alone: np.ndarray, totals: Totals) -> np.ndarray:
    """Log10 weight of the arc that each step takes: the bigram's, or the failure
    arc's and the word's. ``after`` and ``kinds`` count the tokens and the distinct
    tokens after the state; a state that training never left fails for nothing."""
    size = np.maximum(after, 1)
    fall = np.where(after > 0, totals.pair_discount * kinds / size, 1.0)
    seen = np.maximum(pair - totals.pair_discount, 0) / size
    return np.log10(seen + fall * alone)


def scores(docs: DataFrame, folds: int = FOLDS, layout: Layout | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from all documents whose crc32 of the id as text leaves a
    remainder by ``folds``; the others are held out. Tokens are the words between
    ASCII white space, A-Z in lower case, and one end. ``n_known`` counts tokens that
    training has, ``train_tokens`` is their number in training, ``base_score`` is the
    log10 probability by single words with ``BASE`` added to every count, and
    ``score`` that of the model. Both treat all words unknown to training as one.

    Null texts are empty: their one token is the end. Rows without ``doc_id`` are
    scored but neither train nor are held out. One row per row, whatever its id;
    other columns are ignored. Words are told apart by 64-bit hashes. Without
    training tokens all model scores are 0 and base scores follow the formula.
    Runs a job to measure the texts.
    """
    layout = layout or Layout.of(text_bytes(docs))
    blocks = blocked(docs, layout)

    def every_slice(keys: np.ndarray):
        """Also slices without keys: their replies carry their share of the totals."""
        found = {s: (a, b) for s, a, b in by_slice(keys, layout.slices)}
        return [(s, *found.get(s, (0, 0))) for s in range(layout.slices)]

    def send_counts(table: pa.Table):
        walk = Walk(table, folds)
        n, is_pair = walk.counts()
        for s, a, b in every_slice(walk.keys):
            yield s, join_parts(
                pack(walk.keys[a:b]), pack_any(n[a:b]), np.packbits(is_pair[a:b]).tobytes()
            )

    def count(payloads: list[bytes]) -> list[bytes]:
        parts = [split_parts(p) for p in payloads]
        keys = [unpack(p[0]) for p in parts]
        n = np.concatenate([unpack_any(p[1]).astype(np.int64) for p in parts])
        kind = np.concatenate(
            [np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(k)) for p, k in zip(parts, keys)]
        )
        distinct, place, bounds = merged(keys)
        total = np.bincount(place, n, len(distinct)).astype(np.int64)
        pair = np.zeros(len(distinct), bool)
        pair[place] = kind
        # The first block that has it in training is to count a bigram.
        owner = np.zeros(len(place), bool)
        trained = np.flatnonzero(n > 0)
        owner[trained[np.unique(place[trained], return_index=True)[1]]] = True
        words, pairs = total[~pair], total[pair]
        sums = np.array(
            [words.sum(), (words > 0).sum(), (words == 1).sum(), (words == 2).sum(), (pairs == 1).sum(), (pairs == 2).sum()],
            np.int64,
        ).tobytes()
        return [
            join_parts(sums, pack_any(total[place[a:b]]), np.packbits(owner[a:b]).tobytes())
            for a, b in zip(bounds, bounds[1:])
        ]

    def counted(walk: Walk, replies: dict[int, bytes]):
        total, owned = np.zeros(len(walk.keys), np.int64), np.zeros(len(walk.keys), bool)
        sums = np.zeros(6, np.int64)
        for s, a, b in every_slice(walk.keys):
            part = split_parts(replies[s])
            sums += np.frombuffer(part[0], np.int64)
            total[a:b] = unpack_any(part[1])
            owned[a:b] = np.unpackbits(np.frombuffer(part[2], np.uint8), count=b - a)
        return total, owned, Totals(sums)

    def send_states(table: pa.Table, replies: dict[int, bytes]):
        walk = Walk(table, folds)
        tokens, kinds = walk.leaving(counted(walk, replies)[1])
        for s, a, b in by_slice(walk.states, layout.slices):
            yield s, join_parts(pack(walk.states[a:b]), pack_any(tokens[a:b]), pack_any(kinds[a:b]))

    def add_states(payloads: list[bytes]) -> list[bytes]:
        parts = [split_parts(p) for p in payloads]
        distinct, place, bounds = merged([unpack(p[0]) for p in parts])
        sums = [
            np.bincount(place, np.concatenate([unpack_any(p[k]) for p in parts]), len(distinct)).astype(np.int64)
            for k in (1, 2)
        ]
        return [
            join_parts(*(pack_any(x[place[a:b]]) for x in sums)) for a, b in zip(bounds, bounds[1:])
        ]

    def score(table: pa.Table, replies: pa.Table) -> dict:
        walk = Walk(table, folds)
        first = replies.filter(pa.compute.equal(replies.column("step"), 1))
        total, _, totals = counted(walk, dict(zip(first.column("slice").to_pylist(), first.column("payload").to_pylist())))
        after, kinds = np.zeros(len(walk.states), np.int64), np.zeros(len(walk.states), np.int64)
        second = replies.filter(pa.compute.equal(replies.column("step"), 2))
        states = dict(zip(second.column("slice").to_pylist(), second.column("payload").to_pylist()))
        for s, a, b in by_slice(walk.states, layout.slices):
            after[a:b], kinds[a:b] = map(unpack_any, split_parts(states[s]))
        words, pairs = total[walk.word_at], total[walk.pair_at]
        step = arcs(pairs, after[walk.state_at], kinds[walk.state_at], single(words, totals), totals)
        base = np.log10((words + BASE) / (totals.tokens + BASE * (totals.types + 1)))
        return {
            "doc_id": table.column("doc_id").combine_chunks(),
            "held_out": walk.held_out,
            "n_tokens": walk.n_tokens,
            "n_known": np.add.reduceat((words > 0).astype(np.int64), walk.first),
            "train_tokens": np.full(len(walk.first), totals.tokens),
            "base_score": np.add.reduceat(base, walk.first),
            "score": np.add.reduceat(step, walk.first),
        }

    counts = answer(ask(blocks, send_counts), count)
    states = answer(ask_again(blocks, counts, send_states), add_states)
    replies = counts.selectExpr("block", "slice", "payload", "1 AS step").unionByName(
        states.selectExpr("block", "slice", "payload", "2 AS step")
    )
    return finish(
        blocks, replies, score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
