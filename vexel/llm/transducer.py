"""A minimal acyclic transducer from words to id sequences, byte-pair tables, and the file that holds both.

The automaton shares prefixes and suffixes. Each transition carries how many accepted words it skips; the sum along a
word's path is the word's rank, and the rank selects the word's ids. Arrays lie in one file that workers memory-map.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

from .arrays import ragged

NONE = np.int32(2**31 - 1)


class Table:
    """Open-addressing hash table from int64 keys to their positions, looked up many keys at a time."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, slots: np.ndarray):
        self.keys, self.slots, self.shift = keys, slots, np.uint64(64 - int(len(slots)).bit_length() + 1)

    @classmethod
    def build(cls, keys: np.ndarray) -> Table:
        table = cls(keys, np.full(max(16, 1 << (4 * len(keys)).bit_length()), -1, np.int32))
        home, left, step = table._home(keys), np.arange(len(keys)), 0
        while len(left):
            at = (home[left] + step) & (len(table.slots) - 1)
            free = table.slots[at] < 0
            table.slots[at[free]] = left[free]
            left, step = left[table.slots[at] != left], step + 1
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out, at = np.full(len(keys), -1, np.int32), self._home(keys)
        left = np.arange(len(keys) if len(self.keys) else 0)
        while len(left):
            got = self.slots[at[left]]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            left = left[(got >= 0) & ~hit]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        return out


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of sorted distinct words, built incrementally."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path, last = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((final[state], tuple(edges[state].items())), state)
            edges[path[-1]][last[len(path) - 1]] = same

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]], last = True, word
    settle(0)
    # number the states that are left, children first, with the words below each
    number: dict[int, int] = {}
    below: list[int] = []
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            if state not in number:
                number[state] = len(below)
                below.append(final[state] + sum(below[number[x]] for x in edges[state].values()))
        elif state not in number:
            stack.append((state, True))
            stack += [(x, False) for x in edges[state].values()]
    key, to, skip = [], [], []
    for state, n in number.items():
        passed = int(final[state])
        for byte, x in edges[state].items():
            key.append(n * 256 + byte)
            to.append(number[x])
            skip.append(passed)
            passed += below[number[x]]
    accepts = np.zeros(len(number), bool)
    accepts[[n for state, n in number.items() if final[state]]] = True
    keys = np.array(key, np.int64)
    return {"edge_key": keys, "edge_slot": Table.build(keys).slots, "edge_to": np.array(to, np.int32), "edge_skip": np.array(skip, np.int32), "accepts": accepts, "root": np.array([number[0]], np.int32)}


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + bytes(-(len(text) + 8) % 64))
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped: workers of one executor share the pages."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(size + 8) // 64) * 64
    return {name: raw[base + at : base + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


class Lexicon:
    """Ids of words: those in the automaton by walking it, all others by exact merges in order of rank."""

    #: Words up to so many bytes are merged side by side in a matrix; longer ones each with a heap.
    WIDE = 48

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.edges = Table(arrays["edge_key"], arrays["edge_slot"])
        self.pairs = Table(arrays["pair_key"], arrays["pair_slot"])
        self.merged, self.byte_id = arrays["merged"], arrays["byte_id"]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel()
        real = np.flatnonzero(right >= 0)
        out = np.full(len(left), NONE, np.int32)
        got = self.pairs.find(left[real] << 32 | right[real])
        out[real] = np.where(got >= 0, got, NONE)  # a pair's position is its rank
        return out.reshape(shape)

    def walk(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rank of each word in the automaton, or -1."""
        out = np.full(len(start), -1, np.int64)
        row = np.arange(len(start))
        state, rank = np.full(len(start), self.a["root"][0], np.int64), np.zeros(len(start), np.int64)
        step = 0
        while len(row):
            ended = length[row] == step
            if ended.any():
                done = ended & self.a["accepts"][state]
                out[row[done]] = rank[done]
                row, state, rank = row[~ended], state[~ended], rank[~ended]
                if not len(row):
                    break
            edge = self.edges.find(state * 256 + data[start[row] + step])
            on = edge >= 0
            row, edge = row[on], edge[on]
            state, rank = self.a["edge_to"][edge].astype(np.int64), rank[on] + self.a["edge_skip"][edge]
            step += 1
        return out

    def merge_block(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to WIDE bytes, one after the other, and how many each has: in each round every word
        merges its leftmost pair of lowest rank."""
        width = int(length.max())
        at = np.arange(width)
        inside = at < length[:, None]
        ids = np.where(inside, self.byte_id[data[np.where(inside, start[:, None] + at, 0)]], -1).astype(np.int32)
        out = np.full((len(start), width), -1, np.int32)
        row = np.arange(len(start))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if rank.shape[1] == 0:
                out[row, : ids.shape[1]] = ids
                break
            p = rank.argmin(1)
            best = rank[np.arange(len(row)), p]
            on = best != NONE
            out[row[~on], : ids.shape[1]] = ids[~on]
            if not on.any():
                break
            row, ids, rank, p, best = row[on], ids[on], rank[on], p[on], best[on]
            n, at = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, at + (at > p[:, None]), 1)
            ids[n, p] = self.merged[best]
            at = at[:-1]
            rank = np.take_along_axis(rank, at + (at >= p[:, None]), 1)
            has = np.flatnonzero(p > 0)
            rank[has, p[has] - 1] = self.ranks(ids[has, p[has] - 1], ids[has, p[has]])
            has = np.flatnonzero(p < ids.shape[1] - 1)
            rank[has, p[has]] = self.ranks(ids[has, p[has]], ids[has, p[has] + 1])
        return out[out >= 0], (out >= 0).sum(1)

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """The same for one long word, with a heap of pairs over a linked list."""
        ids = self.byte_id[word].astype(np.int64)
        n = len(ids)
        after, before = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
        first = self.ranks(ids[:-1], ids[1:])
        ids, alive = ids.tolist(), [True] * n
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        pair_rank = remembered_ranks(self)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or pair_rank(ids[i], ids[after[i]]) != rank:
                continue
            j = after[i]
            alive[j], ids[i], after[i] = False, int(self.merged[rank]), after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := pair_rank(ids[i], ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pair_rank(ids[before[i]], ids[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x, a in zip(ids, alive) if a], np.int32)

    def encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where each word's begin and how many they are."""
        rank = self.walk(data, start, length)
        known = rank >= 0
        first, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[known] = self.a["ids_at"][rank[known]]
        many[known] = self.a["ids_at"][rank[known] + 1] - first[known]
        flat, size = [self.a["ids"]], len(self.a["ids"])
        low = 0
        for high in (3, 6, 9, 12, 16, 24, self.WIDE):
            todo = np.flatnonzero(~known & (length > low) & (length <= high))
            low = high
            for part in np.array_split(todo, max(1, len(todo) * high // 1_000_000)):
                if len(part):
                    ids, n = self.merge_block(data, start[part], length[part])
                    first[part], many[part] = size + np.cumsum(n) - n, n
                    flat.append(ids)
                    size += len(ids)
        for i in np.flatnonzero(~known & (length > self.WIDE)):
            ids = self.merge_long(data[start[i] : start[i] + length[i]])
            first[i], many[i] = size, len(ids)
            flat.append(ids)
            size += len(ids)
        return np.concatenate(flat), first, many


def remembered_ranks(lexicon: Lexicon):
    """Rank of one pair, remembered, or None."""
    seen: dict[tuple[int, int], int | None] = {}

    def rank(left: int, right: int) -> int | None:
        if (left, right) not in seen:
            got = int(lexicon.ranks(np.array([left]), np.array([right]))[0])
            seen[left, right] = None if got == NONE else got
        return seen[left, right]

    return rank


def pieces(flat: np.ndarray, first: np.ndarray, many: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of words `which`, one after the other."""
    return flat[ragged(first[which], many[which])]
