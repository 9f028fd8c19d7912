"""Byte-level BPE by speculation: greedy longest matches propose the tokens of a
word, a vectorised check tests every adjacent pair, and only words with a failing
pair are merged exactly.

A token sequence is what BPE gives if each token is what BPE makes of its own
bytes and each adjacent pair is compatible, that is, if no merge across the
border is due before both tokens are finished. Children of a merge always rank
before it, so of two neighbours the one with the higher rank was made last. The
check undoes them in that order and looks at the pair that meets at the border.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import mapped, texts, worker_store

#: Splits text into words before any merge (fixed value of byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers of spaces-delimited chunks and of words.
REMEMBERED = 400_000
# Words of more bytes are matched one by one.
_LONG = 256
# Words of more bytes are merged with a heap, shorter ones by scanning.
_SCANNED = 48
_NEVER = np.int64(1) << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Tables of one vocabulary file, and what the worker remembers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(size)]
        self.added = added
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = regex.compile(PATTERN)

        of_byte = {bytes(v): vocab[k] for k, v in ((k, [b]) for k, b in alphabet.items())}
        self.byte_id = np.array([of_byte[bytes([b])] for b in range(256)], np.int64)
        # rank at which a token is made (-1: a byte), its two children, all merges
        self.made = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        pairs, self.merge = np.empty(len(model["merges"]), np.int64), {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[i, j] = rank, made
            pairs[rank] = i << 32 | j
            if self.made[made] < 0:
                self.made[made], self.left[made], self.right[made] = rank, i, j
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int64)
        self._trie({t: vocab[k] for k, i in vocab.items() if (t := self.bytes[i])})
        self.sound = self._sound()
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.first_chunk: dict[str, bytes] = {}
        self.chunk: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}
        self.exact_words = 0

    # -- proposals ---------------------------------------------------------

    def _trie(self, tokens: dict[bytes, int]) -> None:
        edges: dict[int, int] = {}
        ends = {}
        for token, i in tokens.items():
            node = 0
            for b in token:
                node = edges.setdefault(node << 8 | b, len(edges) + 1)
            ends[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges = edges
        self.edge_key = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token_at = np.full(len(edges) + 1, -1, np.int64)
        for node, i in ends.items():
            self.token_at[node] = i

    def propose(self, words: list[bytes]) -> list[np.ndarray]:
        """Greedy longest matches of all words at once, one byte a step."""
        made: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        buffer = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        live = np.flatnonzero(lengths > 0)
        cursor = (ends - lengths)[live]
        start, node = cursor.copy(), np.zeros(len(live), np.int64)
        best, best_end = np.full(len(live), -1, np.int64), cursor.copy()
        while len(live):
            inside = cursor < ends[live]
            key = node << 8 | buffer[np.where(inside, cursor, 0)]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            go = inside & (self.edge_key[at] == key)
            node = np.where(go, self.edge_to[at], 0)
            cursor = np.where(go, cursor + 1, cursor)
            token = self.token_at[node]
            hit = go & (token >= 0)
            best = np.where(hit, token, best)
            best_end = np.where(hit, cursor, best_end)
            stop = ~go
            if stop.any():
                made.append((live[stop], start[stop], best[stop]))
                start = np.where(stop, best_end, start)
                cursor = np.where(stop, best_end, cursor)
                more = start < ends[live]
                if not more.all():
                    live, cursor, start, node = live[more], cursor[more], start[more], node[more]
                    best, best_end = best[more], best_end[more]
        if not made:
            return [np.empty(0, np.int64) for _ in words]
        start = np.concatenate([m[1] for m in made])
        order = np.argsort(start)
        ids = np.concatenate([m[2] for m in made])[order]
        counts = np.bincount(np.concatenate([m[0] for m in made]), minlength=len(words))
        return np.split(ids, np.cumsum(counts)[:-1])

    def propose_long(self, word: bytes) -> np.ndarray:
        ids, at = [], 0
        while at < len(word):
            node, end, cursor = 0, at, at
            while cursor < len(word):
                node = self.edges.get(node << 8 | word[cursor], 0)
                if not node:
                    break
                cursor += 1
                if self.token_at[node] >= 0:
                    token, end = int(self.token_at[node]), cursor
            ids.append(token)
            at = end
        return np.array(ids, np.int64)

    # -- checks ------------------------------------------------------------

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

    def _undisturbed(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of ``x`` and ``y`` is due before
        ``limit``, nor before any of the merges that made them."""
        fits = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            clash = self._rank(x, y) < limit
            fits[live[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            # Of equal tokens the right one was made last; inside it the border
            # comes first, so a merge of the same rank crosses it.
            undo_x = made_x > made_y
            limit = np.where(undo_x, made_x, made_y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return fits

    def _sound(self) -> np.ndarray:
        """Tokens that BPE makes of their own bytes."""
        tokens = np.flatnonzero(self.made >= 0)
        good = np.ones(len(self.made), bool)
        good[tokens] = self._undisturbed(self.left[tokens], self.right[tokens], self.made[tokens])
        for t in tokens[np.argsort(self.made[tokens])].tolist():
            good[t] &= good[self.left[t]] and good[self.right[t]]
        return good

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code, back = np.unique(x << 32 | y, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, code), max(0, len(self.known) - 1))
        seen = self.known[at] == code if len(self.known) else np.zeros(len(code), bool)
        fits = self.fits[at] & seen if len(self.known) else seen.copy()
        new = code[~seen]
        if len(new):
            verdict = self._undisturbed(new >> 32, new & 0xFFFFFFFF, np.full(len(new), _NEVER))
            fits[~seen] = verdict
            if len(self.known) > 4 * REMEMBERED:
                self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
            every = np.concatenate([self.known, new])
            order = np.argsort(every)
            self.known = every[order]
            self.fits = np.concatenate([self.fits, verdict])[order]
        return fits[back]

    # -- exact merging -----------------------------------------------------

    def merge_exactly(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        if len(ids) <= _SCANNED:
            return self._merge_scanning(ids)
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        due = []
        for i in range(len(ids) - 1):
            if (found := self.merge.get((ids[i], ids[i + 1]))) is not None:
                due.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(due)
        while due:
            _, i, a, b = heapq.heappop(due)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    pair = ids[k], ids[after[k]]
                    if (found := self.merge.get(pair)) is not None:
                        heapq.heappush(due, (found[0], k, *pair))
        return np.array([i for i in ids if i >= 0], np.int64)

    def _merge_scanning(self, ids: list[int]) -> np.ndarray:
        never = (int(_NEVER), -1)
        merge = self.merge.get
        due = [merge(pair, never) for pair in zip(ids, ids[1:])]
        while due and (best := min(due)) is not never:
            i = due.index(best)
            ids[i : i + 2] = [best[1]]
            del due[i]
            if i:
                due[i - 1] = merge((ids[i - 1], ids[i]), never)
            if i < len(due):
                due[i] = merge((ids[i], ids[i + 1]), never)
        return np.array(ids, np.int64)

    # -- words, chunks, texts ----------------------------------------------

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        short = [w for w in raw if len(w) <= _LONG]
        proposals = iter(self.propose(short))
        found = [next(proposals) if len(w) <= _LONG else self.propose_long(w) for w in raw]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate(found) if found else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(found)), counts)
        failing = np.zeros(len(found), bool)
        failing[owner[~self.sound[ids]]] = True
        border = np.flatnonzero(owner[:-1] == owner[1:])
        fits = self.compatible(ids[border], ids[border + 1])
        failing[owner[border[~fits]]] = True
        for i in np.flatnonzero(failing).tolist():
            found[i] = self.merge_exactly(raw[i])
        self.exact_words += int(failing.sum())
        return found

    def _learn_words(self, words: set[str]) -> None:
        if len(self.word) > REMEMBERED:
            self.word.clear()
        new = [w for w in words if w not in self.word]
        for word, ids in zip(new, self.encode_words(new)):
            self.word[word] = ids.astype("<u4").tobytes()

    def _learn_chunks(self, missing: set[str], into: dict[str, bytes], lead: str) -> None:
        parts = {}
        for chunk in missing:
            if found := _WORD.fullmatch(chunk):
                word, marks = found.groups()
                parts[chunk] = [lead + word, marks] if marks else [lead + word]
            else:
                parts[chunk] = self.words.findall(lead + chunk)
        self._learn_words({w for words in parts.values() for w in words})
        for chunk, words in parts.items():
            into[chunk] = b"".join([self.word[w] for w in words])

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers.

        A text is cut at single blanks first: a word never goes on across a blank
        that has no white space on one of its sides. Texts with other blanks, or
        with a special token, are cut into words as a whole."""
        simple: list[tuple[int, list[str]]] = []
        out: list[bytes] = [b""] * len(batch)
        for i, text in enumerate(batch):
            if _BLANK_BETWEEN.search(text) or (self.added_pattern and self.added_pattern.search(text)):
                out[i] = self._encode_whole(text)
            elif text:
                simple.append((i, text.split(" ")))
        for learnt in (self.first_chunk, self.chunk):
            if len(learnt) > REMEMBERED:
                learnt.clear()
        self._learn_chunks({c[0] for _, c in simple} - self.first_chunk.keys(), self.first_chunk, "")
        # A few first chunks are learnt here without need.
        later = set().union(*(chunks for _, chunks in simple)) - self.chunk.keys()
        self._learn_chunks(later, self.chunk, " ")
        look = self.chunk.__getitem__
        for i, chunks in simple:
            out[i] = self.first_chunk[chunks[0]] + b"".join(map(look, chunks[1:]))
        return out

    def _encode_whole(self, text: str) -> bytes:
        pieces = self.added_pattern.split(text) if self.added_pattern else [text]
        parts = []
        for piece in pieces:
            if piece in self.added:
                parts.append(np.array([self.added[piece]], "<u4").tobytes())
                continue
            words = self.words.findall(piece)
            self._learn_words(set(words))
            parts.extend(self.word[w] for w in words)
        return b"".join(parts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_BLANK_BETWEEN = re.compile(r"\s \s")
# The most common chunk, a word of Latin letters and the ASCII marks after it, which
# the pattern cuts in two.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file, made once."""
    store = worker_store().setdefault("bpe", {})
    if path not in store:
        store[path] = Codec(path)
    return store[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text.

    Special tokens written in a text become their ids; none are added. Null and
    empty texts have no ids. One row per input row, whatever its id; other columns
    are ignored. ``vocabulary`` is a file of the tokenizers library that every
    executor has.
    """
    path = vocabulary or default_vocabulary()

    def work(batch):
        made = codec(path).encode(batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"),
            "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in made],
        }

    return mapped(texts(docs), work, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. Bytes that are no UTF-8 become the
    replacement character; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def work(batch):
        c = codec(path)
        return {
            "doc_id": batch.column("doc_id"),
            "text": [c.decode(ids or []) for ids in batch.column("ids").to_pylist()],
        }

    return mapped(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and
    decoded again, in one pass. Rows and nulls as in ``encode``."""
    path = vocabulary or default_vocabulary()

    def work(batch):
        c = codec(path)
        rows = [np.frombuffer(x, "<u4").tolist() for x in c.encode(batch.column("text").to_pylist())]
        sha = hashlib.sha256
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(ids) for ids in rows],
            "ids_sha256": [
                sha(b",".join(map(c.decimal.__getitem__, ids))).hexdigest() for ids in rows
            ],
            "decoded_sha256": [sha(c.decode(ids).encode()).hexdigest() for ids in rows],
        }

    return mapped(
        texts(docs), work,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
