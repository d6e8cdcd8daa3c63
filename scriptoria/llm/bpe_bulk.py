"""The prefix dynamic program for many short byte strings at once, as arrays.

Every prefix of every string gets its unique valid last token: the tokens that end a prefix are found on a trie of
reversed tokens, and, prefix length by prefix length, the longest one that may stand next to the last token of what
comes before it is stored. Whether two tokens may stand side by side is worked out once and kept in a table of fixed
size, in which a newer pair replaces an older one: that saves work and never decides a result.
"""

from __future__ import annotations

import numpy as np

#: Entries of the table of pairs that are known to stay apart or not.
SLOTS = 1 << 20
#: A rank above all others.
NEVER = np.int64(1) << 40


class Lookup:
    """int64 keys to int32 values; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys) - 1).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            done = self.keys[slot] == keys[left]
            self.values[slot[done]] = values[left[done]]
            slot, left = (slot[~done] + 1) & self.mask, left[~done]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out


class Bulk:
    def __init__(self, encoder):
        """encoder has ranks (bytes to rank), bytes_of (rank to bytes) and halves(rank)."""
        self.encoder = encoder
        ranks = encoder.ranks
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, np.int32)
        tokens = np.array(sorted(ranks.values()), np.int64)
        self.length[tokens] = [len(encoder.bytes_of[t]) for t in tokens.tolist()]
        self._build_trie(tokens)
        #: What merges make a token of: unknown (-2) until it is asked for, -1 for single bytes and tokens out of reach.
        self.left, self.right = np.full(self.size, -2, np.int32), np.full(self.size, -2, np.int32)
        self.made = np.zeros(self.size, bool)
        a, b, whole = [], [], []
        for data, rank in ranks.items():
            for k in range(1, len(data)):
                x, y = ranks.get(data[:k]), ranks.get(data[k:])
                if x is not None and y is not None:
                    a.append(x)
                    b.append(y)
                    whole.append(rank)
        self.joined = Lookup(np.array(a, np.int64) * self.size + np.array(b, np.int64), np.array(whole, np.int32))
        self.pair, self.apart_of = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _build_trie(self, tokens: np.ndarray) -> None:
        """Nodes of reversed tokens: edges by node and byte, and the token that ends at each node."""
        data = b"".join(self.encoder.bytes_of[t] for t in tokens.tolist())
        flat, length = np.frombuffer(data, np.uint8).astype(np.int64), self.length[tokens].astype(np.int64)
        end = np.cumsum(length)
        node, alive, nodes = np.zeros(len(tokens), np.int64), np.arange(len(tokens)), 1
        keys, children, token_at = [], [], [np.full(1, -1, np.int32)]
        for back in range(1, int(length.max(initial=0)) + 1):
            alive = alive[length[alive] >= back]
            edge, where = np.unique((node[alive] << 8) | flat[end[alive] - back], return_inverse=True)
            node[alive] = nodes + where
            keys.append(edge)
            children.append(nodes + np.arange(len(edge)))
            ends = np.full(len(edge), -1, np.int32)
            done = length[alive] == back
            ends[where[done]] = tokens[alive[done]]
            token_at.append(ends)
            nodes += len(edge)
        self.child = Lookup(np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *children]))
        self.token_at = np.concatenate(token_at)
        #: The children of the root and of its children without a search.
        self.near = self.child(np.arange(min(nodes, 257) << 8))

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        edge = (node << 8) | byte
        return self.near[edge] if len(node) and node.max() < 257 else self.child(edge)

    def _learn(self, tokens: np.ndarray) -> None:
        """Find out what makes these tokens, and all those that they are made of."""
        todo = np.unique(tokens[self.left[tokens] == -2]).tolist()
        while todo:
            t = todo[-1]
            two = self.encoder.halves(t)
            if two is None:
                self.left[t] = self.right[t] = -1
                self.made[t] = self.length[t] == 1
                todo.pop()
                continue
            below = [x for x in two if self.left[x] == -2]
            if below:
                todo += below
                continue
            self.left[t], self.right[t] = two
            self.made[t] = self.made[two[0]] and self.made[two[1]]
            todo.pop()

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a and b side by side: going back from both, merge by merge, the later one first, no pair
        across the border may have had a rank that was due before the merges already gone back over."""
        out, left = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        x, y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(left):
            across = self.joined(a * self.size + b)
            merged = (across >= 0) & (across < x) & (across <= y)
            out[left[merged]] = False
            single_a, single_b = self.length[a] == 1, self.length[b] == 1
            going = ~(merged | (single_a & single_b))
            second = ~single_b & (single_a | (b >= a))
            x, y = np.where(second, x, a), np.where(second, b, y)
            a, b = np.where(second, a, self.right[a]), np.where(second, self.left[b], b)
            left, a, b, x, y = left[going], a[going], b[going], x[going], y[going]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.apart_of[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            found = self._walk(asked // self.size, asked % self.size)
            out[new] = found[back]
            self.pair[slot[new]], self.apart_of[slot[new]] = key[new], out[new]
        return out

    def tokens(self, strings: list[bytes]) -> list[list[int]]:
        """The tokens of each string; strings must not be empty."""
        if not strings:
            return []
        # Bytes are numbered place by place, within a place by string, longest strings first: those of place k are
        # base[k] onwards, and a string has the same number within each place.
        order = sorted(range(len(strings)), key=lambda k: -len(strings[k]))
        size = np.array([len(strings[k]) for k in order], np.int64)
        data = np.frombuffer(b"".join([strings[k] for k in order]), np.uint8)
        start, places = np.cumsum(size) - size, int(size[0])
        active = np.searchsorted(-size, -np.arange(places), "left")
        base = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate([data[start[:m] + k] for k, m in enumerate(active.tolist())]).astype(np.int64)
        place = np.repeat(np.arange(places), active)
        string = np.arange(len(flat)) - base[place]
        # All tokens that end at each byte, longest first.
        at, node, ends, tokens = np.arange(len(flat)), np.zeros(len(flat), np.int64), [], []
        for back in range(places):
            node = self._step(node, flat[base[place[at] - back] + string[at]])
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive].astype(np.int64)
            token = self.token_at[node]
            known = np.flatnonzero(token >= 0)
            ends.append(at[known])
            tokens.append(token[known])
            more = np.flatnonzero(place[at] > back)
            at, node = at[more], node[more]
            if not len(at):
                break
        ends, tokens = np.concatenate(ends[::-1]), np.concatenate(tokens[::-1])
        self._learn(tokens)
        usable = np.flatnonzero(self.made[tokens])
        usable = usable[np.argsort(ends[usable], kind="stable")]
        ends, tokens = ends[usable], tokens[usable]
        length = self.length[tokens]
        first = np.flatnonzero(np.diff(ends, prepend=-1))
        count = np.diff(np.append(first, len(ends)))
        if len(first) < len(flat):
            raise ValueError("a byte without a token")
        last = np.full(len(flat), -1, np.int64)
        for k, m in enumerate(active.tolist()):
            who = np.arange(m)
            look, left = first[base[k] : base[k] + m], count[base[k] : base[k] + m]
            while len(who):
                token, n = tokens[look], length[look]
                fits = n == k + 1
                inner = np.flatnonzero(~fits)
                fits[inner] = self.apart(last[base[k - n[inner]] + who[inner]], token[inner])
                last[base[k] + who[fits]] = token[fits]
                going = np.flatnonzero(~fits)
                who, look, left = who[going], look[going] + 1, left[going] - 1
                if (left == 0).any():
                    raise ValueError("a byte without a token")
        # The encoding is read off backwards.
        at, who, out = size - 1, np.arange(len(strings)), []
        while len(who):
            token = last[base[at] + who]
            out.append((who, token))
            at = at - self.length[token]
            inside = np.flatnonzero(at >= 0)
            at, who = at[inside], who[inside]
        who, found = np.concatenate([x for x, _ in out[::-1]]), np.concatenate([x for _, x in out[::-1]])
        back = np.argsort(who, kind="stable")
        limits, found = np.searchsorted(who[back], np.arange(len(strings) + 1)).tolist(), found[back].tolist()
        result: list[list[int]] = [[]] * len(strings)
        for k, i, j in zip(order, limits, limits[1:]):
            result[k] = found[i:j]
        return result
