"""Distinct sampled segmentations: Gumbel top-k over the piece lattice, and decoding."""

from __future__ import annotations

import heapq
import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm import shingles as S
from hustings.llm.common import narrow, read
from hustings.llm.token_counts import processor

#: Samples for each text.
SAMPLES = 2
#: Edges from which a worker drops the lattices it holds before it makes new ones.
MOST_EDGES = 5_000_000
#: Characters from the end within which pre-tokens that end alike share their states.
SHARED = 64
#: Log-shares further apart than this can't be told from nothing in doubles.
ROUNDING = 60.0
#: Bytes of text that are sampled side by side.
CHUNK = 1 << 17
#: Characters (or steps) up to which pre-tokens go side by side; what longer ones have beyond goes one by one.
ABREAST = 2048


class Numbers:
    """A hash table from numbers to numbers, for numpy."""

    def __init__(self):
        self._room(16)

    def _room(self, bits: int):
        self.held, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.empty(1 << bits, np.int32)

    def _slot(self, keys):
        return (keys.view(np.uint64) * S.BASE >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """What the keys lead to, -1 for those that aren't held."""
        at = self._slot(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], np.int64(-1))
        open_ = np.flatnonzero((found >= 0) & ~hit)
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found, key = self.keys[at[open_]], keys[open_]
            out[open_] = np.where(found == key, self.values[at[open_]], -1)
            open_ = open_[(found != key) & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray):
        """Hold keys that are new and differ."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old, own = self.keys, self.values
            self._room((4 * (self.held + len(keys))).bit_length())
            self.put(old[old >= 0], own[old >= 0])
        self.held += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys  # of those that meet in a free place one gets it
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask


class Trie:
    """Prefixes of all pieces: from node and character to node."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        edges: dict[int, int] = {}
        self.piece, self.weight = [-1], [0.0]
        for text, (piece, weight) in pieces.items():
            node = 0
            for ch in text:
                key = node << 21 | ord(ch)
                if key not in edges:
                    edges[key] = len(self.piece)
                    self.piece.append(-1)
                    self.weight.append(0.0)
                node = edges[key]
            self.piece[node], self.weight[node] = piece, weight
        self.piece, self.weight = np.array(self.piece), np.array(self.weight)
        self.nodes = Numbers()
        self.nodes.put(np.array(list(edges), np.int64), np.array(list(edges.values())))

    def step(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, -1 where no piece goes on."""
        return self.nodes.find(node << 21 | ch)


class Lattice:
    """Lattices of pre-tokens as one table of states and edges.

    A merge model has ranks and no probabilities: a piece of rank r weighs
    1 / (r + 2), as frequencies fall with the rank; a unigram model's scores are its
    log-probabilities.  A character that is no piece becomes its bytes, each with the
    least weight.  Edges carry the probability of their choice given the state, as
    the backward sums over all ways to the end of the pre-token make it.  All that a
    state has follows from the characters up to the end, so pre-tokens that end alike
    share states: one is found by its character and the state of what comes after.
    """

    def __init__(self, model_file: str):
        sp = processor(model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = all(float(sp.get_score(i)).is_integer() for i in plain)
        weight = lambda i: -math.log(2 - sp.get_score(i)) if ranked else sp.get_score(i)
        pieces = {sp.id_to_piece(i): (i, weight(i)) for i in plain}
        self.trie = Trie(pieces)
        self.least = min(w for _, w in pieces.values())
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.small = n <= 1 << 16
        self.clear()

    def clear(self):
        """Empty tables.  By edge: the state it leads to (-1: the end), piece, log-probability,
        and the share of its state's probability up to and with it; by state: its first edge,
        character, the state behind that, and the log of the sum over all ways to the end."""
        self.target, self.piece = np.empty(0, np.int32), np.empty(0, np.uint16 if self.small else np.int32)
        self.log, self.until = np.empty(0), np.empty(0, np.float32)
        self.first = np.empty(0, np.int64)
        self.char, self.rest, self.sums = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        self.known, self.edges, self.states = Numbers(), 0, 0

    def _grow(self, names: str, size: int):
        for name in names.split():
            held = getattr(self, name)
            if len(held) < size:
                wider = np.zeros(max(size, 2 * len(held)), held.dtype)
                wider[: len(held)] = held
                setattr(self, name, wider)

    def states_of(self, tokens: list[str]) -> np.ndarray:
        """The first state of each token."""
        return self.states_at(_points("".join(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))

    def states_at(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first state of each token, given their characters in a row; what is new gets its lattices now, all at once."""
        if not len(sizes):
            return np.empty(0, np.int64)
        if self.edges > MOST_EDGES:
            self.clear()
        self._grow("char rest first sums", self.states + len(points) + 1)  # the last sum stays 0, as the end's
        starts, upto = self._states(points, sizes)
        if upto[-1] > self.states:
            self._add(upto)
        return starts

    def _states(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The first state of each token, and how many states there are up to each distance
        from the end, as new ones get their numbers by it."""
        by_size = np.argsort(-sizes, kind="stable")
        stop, falling = np.cumsum(sizes)[by_size], -sizes[by_size]
        now = np.full(len(sizes), -1)
        states, upto = self.states, [self.states]
        for far, lanes in enumerate(np.searchsorted(falling, -np.arange(1, min(-falling[0], SHARED) + 1), "right").tolist(), 1):
            key = now[:lanes] + 1 << 21 | points[stop[:lanes] - far]
            state = self.known.find(key)
            new = np.flatnonzero(state < 0)
            if len(new):
                fresh, which = np.unique(key[new], return_inverse=True)
                ids = np.arange(states, states + len(fresh))
                self.char[ids[0] : ids[-1] + 1], self.rest[ids[0] : ids[-1] + 1] = fresh & (1 << 21) - 1, (fresh >> 21) - 1
                self.known.put(fresh, ids)
                state[new] = ids[which]
                states += len(fresh)
            now[:lanes] = state
            upto.append(states)
        lanes = int(np.searchsorted(falling, -SHARED))
        if lanes:  # what comes before the shared ends, for each token its own
            more = -falling[:lanes] - SHARED
            of, far = np.repeat(np.arange(lanes), more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            order = np.argsort(far, kind="stable")
            ids = np.empty(len(of), np.int64)
            ids[order] = np.arange(states, states + len(of))
            self.char[ids] = points[stop[of] - SHARED - 1 - far]
            self.rest[ids] = np.where(far > 0, np.roll(ids, 1), now[of])
            now[:lanes] = ids[np.cumsum(more) - 1]
            upto += (states + np.cumsum(np.bincount(far))).tolist()
        first = np.empty(len(sizes), np.int64)
        first[by_size] = now
        return first, upto

    def _add(self, upto: list[int]):
        """The edges of new states."""
        base, e, fresh = self.states, self.edges, upto[-1] - self.states
        source, goes, piece, weight, rank = [], [], [], [], []
        held = np.zeros(fresh, np.int64)  # edges of each state so far
        live, node, at = np.arange(fresh), np.zeros(fresh, np.int64), np.arange(base, upto[-1])
        while len(live):
            node = self.trie.step(node, self.char[at])
            on = np.flatnonzero(node >= 0)
            live, node, at = live[on], node[on], self.rest[at[on]]
            hit = np.flatnonzero(self.trie.piece[node] >= 0)
            found = live[hit]
            source.append(found)
            goes.append(at[hit])
            rank.append(held[found])
            held[found] += 1
            piece.append(self.trie.piece[node[hit]])
            weight.append(self.trie.weight[node[hit]])
            more = np.flatnonzero(at >= 0)
            live, node, at = live[more], node[more], at[more]
        # A character without a piece of its own is spelled in bytes, one state after another.
        own = np.ones(fresh, bool)
        own[source[0]] = False
        own = np.flatnonzero(own)
        spare, spelled = [], []
        for point, after in zip(self.char[base + own].tolist(), self.rest[base + own].tolist(), strict=True):
            data = chr(point).encode("utf-8", "surrogatepass")
            chain = [upto[-1] + len(spare) + m for m in range(len(data) - 1)]
            spare += zip([*chain[1:], after], (self.bytes[b] for b in data[1:]), strict=True) if chain else []
            spelled.append((self.bytes[data[0]], self.least * len(data), chain[0] if chain else after))
        n = int(held.sum()) + len(own)
        self._grow("target piece log until", e + n + len(spare))
        self._grow("first sums", upto[-1] + len(spare) + 1)
        source = np.concatenate([*source, own])
        rank = np.concatenate([*rank, held[own]])
        held[own] += 1
        # State by state, the longest edge first.
        head = np.cumsum(held) - held
        spot = head[source] + held[source] - 1 - rank
        to, w = np.empty(n, np.int64), np.empty(n)
        to[spot] = np.concatenate([*goes, self.rest[base + own]])
        w[spot] = np.concatenate([*weight, np.array([x[1] for x in spelled])])
        self.target[e : e + n] = to
        self.piece[e + spot] = np.concatenate([*piece, np.array([x[0] for x in spelled], np.int64)])
        if spelled:
            self.target[e + spot[-len(own) :]] = [x[2] for x in spelled]
        # The backward sums, by distance from the end.
        sums = self.sums
        for a, b in itertools.pairwise(upto[: ABREAST + 1]):
            if a < b:
                i, j = head.item(a - base), head.item(b - 1 - base) + held.item(b - 1 - base)
                w[i:j] += sums[to[i:j]]
                first = head[a - base : b - base] - i
                top = np.maximum.reduceat(w[i:j], first)
                sums[a:b] = top + np.log(np.add.reduceat(np.exp(w[i:j] - np.repeat(top, held[a - base : b - base])), first))
        if len(upto) > ABREAST + 1:
            self._add_up(upto[ABREAST] - base, base, head, to, w)
        log = np.minimum(w - np.repeat(sums[base : upto[-1]], held), 0.0)
        log[head[held == 1]] = 0.0
        until = np.exp(log)
        more, nth = np.flatnonzero(held > 1), 1
        while len(more):
            until[head[more] + nth] += until[head[more] + nth - 1]
            nth += 1
            more = more[held[more] > nth]
        until[head + held - 1] = 2.0
        self.log[e : e + n], self.until[e : e + n] = log, until
        self.first[base : upto[-1]] = e + head
        for k, (state, byte) in enumerate(spare):
            self.target[e + n + k], self.piece[e + n + k], self.log[e + n + k], self.until[e + n + k] = state, byte, 0.0, 2.0
            self.first[upto[-1] + k] = e + n + k
        self.edges += n + len(spare)
        self.states = upto[-1] + len(spare)
        self.first[self.states] = self.edges

    def _add_up(self, begin, base, head, to, w):
        """The backward sums of states that come one by one, as in few and very long pre-tokens."""
        edge = head.item(begin)
        heads, goes, weights = (head[begin:] - edge).tolist(), to[edge:].tolist(), w[edge:].tolist()
        done: dict[int, float] = {}
        for state, (a, b) in enumerate(itertools.pairwise([*heads, len(goes)]), base + begin):
            for i in range(a, b):
                weights[i] += done[goes[i]] if goes[i] in done else self.sums.item(goes[i])
            top = max(weights[a:b])
            done[state] = top + math.log(sum(math.exp(v - top) for v in weights[a:b]))
        self.sums[base + begin : base + begin + len(heads)] = list(done.values())
        w[edge:] = weights


@lru_cache(maxsize=1)
def surfaces(model_file: str) -> list[bytes]:
    """What each piece spells: a blank for U+2581, a byte for a byte piece, nothing for control pieces."""
    sp = processor(model_file)

    def spell(i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[3:5], 16)])
        return b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    return [spell(i) for i in range(sp.get_piece_size())]


@lru_cache(maxsize=1)
def lattice(model_file: str) -> Lattice:
    return Lattice(model_file)


def _points(text: str) -> np.ndarray:
    """The characters of a text, blanks as the vocabulary writes them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    return np.where(points == ord(" "), np.int32(ord("▁")), points)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters that ``pre_tokens`` has of the texts, the size of each pre-token, and how many each text has."""
    points = _points("".join(" " + t for t in texts if t))
    ends = np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    blank, feed = points == ord("▁"), points == ord("\n")
    begins = np.ones(len(points) + 1, bool)
    # A blank behind no blank, a line feed behind none, anything behind a line feed.
    begins[1:-1] = (blank[1:] > blank[:-1]) | (feed[1:] != feed[:-1])
    begins[ends] = True
    begin = np.flatnonzero(begins)
    return points, np.diff(begin), np.diff(np.searchsorted(begin, ends), prepend=0)


def lane_keys(seed: np.ndarray, draw: int, at: np.ndarray) -> np.ndarray:
    """A key for each row seed, draw and place."""
    return S.mix(seed + S.mix(at.astype(np.uint64) * S.STEP + np.uint64((draw + 1) * int(S.BASE) & (1 << 64) - 1)))


def unit(x: np.ndarray) -> np.ndarray:
    """Keys as numbers between 0 and 1."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def uniform(seed: np.ndarray, draw: int, at: np.ndarray) -> np.ndarray:
    """A number between 0 and 1 that row seed, draw and place decide."""
    return unit(lane_keys(seed, draw, at))


def _walk(table, keys, state):
    """Follow random edges from each lane's state to the end of its pre-token.

    Lanes go side by side, an edge each a step.  Gives all edges, lane by lane, and
    how many each lane has.
    """
    steps, live = [], np.flatnonzero(state >= 0)
    count = np.zeros(len(state), np.int64)
    now = state[live]
    keys = keys[live]
    while len(live) and len(steps) < ABREAST:
        u = unit(S.mix(keys + np.uint64((len(steps) + 1) * int(S.STEP) & (1 << 64) - 1)))
        edge = table.first[now]
        on = np.flatnonzero(table.until[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[table.until[edge[on]] < u[on]]
        steps.append((live, edge))
        count[live] += 1
        now = table.target[edge]
        going = now >= 0
        live, now, keys = live[going], now[going], keys[going]
    rest = [_walk_on(table, key, state) for key, state in zip(keys, now.tolist(), strict=True)]
    count[live] += [len(r) for r in rest] if rest else 0
    offset = np.concatenate([[0], np.cumsum(count)])
    edges = np.zeros(offset[-1], np.int64)
    for r, (who, edge) in enumerate(steps):
        edges[offset[who] + r] = edge
    for who, found in zip(live.tolist(), rest, strict=True):
        edges[offset[who] + ABREAST : offset[who + 1]] = found
    return edges, count


def _walk_on(table, key, state) -> list[int]:
    """What is left of a long lane, edge by edge."""
    out = []
    while state >= 0:
        if len(out) % ABREAST == 0:
            step = np.arange(ABREAST + len(out) + 1, 2 * ABREAST + len(out) + 1).astype(np.uint64)
            draws = unit(S.mix(key + step * S.STEP)).tolist()
        u, edge = draws[len(out) % ABREAST], table.first.item(state)
        while table.until.item(edge) < u:
            edge += 1
        out.append(edge)
        state = table.target.item(edge)
    return out


def gumbel_below(top, location, u):
    """A Gumbel variable at ``location``, given that it is less than ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return location - np.log(np.exp(np.minimum(location - top, 700.0)) - np.log(u))


def top_k(texts: list[str], seeds: np.ndarray, table: Lattice, k: int):
    """For each text up to ``k`` different segmentations: (ids, log-probability, perturbed
    log-probability), best perturbed first, and the perturbed value of the next one.

    A search over regions, each all ways to go on from a prefix without some next
    edges.  The best of a region's perturbed log-probabilities is a Gumbel variable at
    the log of its mass, so regions wait in a queue by it.  The region at the front
    gives its best way (drawn with the edges' probabilities) and falls apart into
    the regions that branch off that way, each perturbed below what it came from.
    """
    points, sizes, lanes = split(texts)
    starts = table.states_at(points, sizes)
    target, piece, log, first = table.target, table.piece, table.log, table.first[: table.states + 1]
    lane0 = np.concatenate([[0], np.cumsum(lanes)])
    docs = len(texts)
    out: list[list] = [[] for _ in range(docs)]
    root = -np.log(-np.log(uniform(seeds, 0, np.zeros(docs, np.int64))))
    # (-perturbed, tie, path and how much of it is kept, mass before, lane, state, edges left out)
    queues: list[list] = [[(-x, 0, (_NO_PATH, 0), 0.0, 0, -1, ())] for x in root.tolist()]
    ties = 1
    for rank in range(k):
        picked = [(d, heapq.heappop(queues[d])) for d in range(docs) if queues[d]]
        if not picked:
            break
        doc = np.array([d for d, _ in picked])
        value, mass = (np.array([sign * x[c] for _, x in picked]) for sign, c in ((-1, 0), (1, 3)))
        lane, state = (np.array([x[c] for _, x in picked], np.int64) for c in (4, 5))
        n = lane0[doc + 1] - lane0[doc] - lane
        cut = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(np.arange(len(picked)), n)
        lane_at = np.arange(cut[-1]) - cut[of] + lane[of]
        begin = starts[lane0[doc[of]] + lane_at]
        inner = np.flatnonzero(state >= 0)  # their first edge avoids those that are left out
        choice = _other_edges(table, state[inner], [picked[r][1][6] for r in inner.tolist()], uniform(seeds[doc[inner]], 2 * rank + 1, (lane[inner] << 20) + (1 << 19)))
        begin[cut[inner]] = target[choice]
        edges, count = _walk(table, lane_keys(seeds[doc[of]], 2 * rank + 1, lane_at << 20), begin)
        ends = np.concatenate([[0], np.cumsum(count)])
        size = ends[cut[1:]] - ends[cut[:-1]] + (state >= 0)
        at = np.concatenate([[0], np.cumsum(size)])
        fresh, lane_of, walked = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64), np.ones(at[-1], bool)
        walked[at[inner]] = False
        fresh[at[inner]], lane_of[at[inner]] = choice, lane[inner]
        fresh[walked], lane_of[walked] = edges, np.repeat(lane_at, count)
        logs, pieces = log[fresh], piece[fresh]
        before = np.empty(at[-1])  # by row: sums that don't depend on the texts beside it
        for (d, region), a, b in zip(picked, at[:-1].tolist(), at[1:].tolist(), strict=True):
            total = region[3]
            if b > a:
                run = np.cumsum(logs[a:b])
                before[a] = total
                np.add(run[:-1], total, out=before[a + 1 : b])
                total += float(run[-1])
            path, kept = region[2]
            out[d].append((pieces[a:b] if kept == 0 else np.concatenate([piece[path[:kept]], pieces[a:b]]), total, -region[0]))
        # What branches off at each edge: all other edges of its state.  Where the prefix's
        # share is below the rounding of the largest branch, no branch can matter.
        whose = np.repeat(np.arange(len(picked)), size)
        place = np.arange(at[-1]) - at[whose]
        near = np.flatnonzero((before > mass[whose] - ROUNDING) | (place == 0))
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(logs[near]), 0.0))
        heads = np.searchsorted(near, at[inner])
        for r, h, e in zip(inner.tolist(), heads.tolist(), choice.tolist(), strict=True):
            left_out = picked[r][1][6]
            gone = math.fsum(math.exp(log[x]) for x in (*left_out, e))
            open_edges = first[state[r] + 1] - first[state[r]] > len(left_out) + 1
            rest[h] = math.log(1 - gone) if open_edges and gone < 1 else -math.inf
        branch = near[np.isfinite(rest)]
        region = whose[branch]
        values = gumbel_below(value[region], before[branch] + rest[np.isfinite(rest)], uniform(seeds[doc[region]], 2 * rank + 2, place[branch]))
        order = np.lexsort((-values, region))
        nth = np.arange(len(order)) - np.searchsorted(region[order], region[order])
        best = order[nth < k - rank]  # those that can be taken, and the next one
        chosen = branch[best]
        sources = np.searchsorted(first, fresh[chosen], "right") - 1
        for r, v, s, edge, m, where, source in zip(*(x.tolist() for x in (region[best], values[best], place[chosen], fresh[chosen], before[chosen], lane_of[chosen], sources)), strict=True):
            d, (_, _, (path, kept), _, _, from_state, left_out) = picked[r]
            if s == 0 and from_state >= 0:
                heapq.heappush(queues[d], (-v, ties, (path, kept), m, where, from_state, (*left_out, edge)))
            else:
                own = fresh[at[r] : at[r] + s]
                heapq.heappush(queues[d], (-v, ties, (own if kept == 0 else np.concatenate([path[:kept], own]), kept + s), m, where, source, (edge,)))
            ties += 1
    return [(found, -queue[0][0] if queue else -math.inf) for found, queue in zip(out, queues, strict=True)]


_NO_PATH = np.zeros(0, np.int64)


def _other_edges(table, state, left_out, u):
    """For each state one of its edges but for those left out, by their probabilities."""
    if not len(state):
        return np.zeros(0, np.int64)
    begin, size = table.first[state], table.first[state + 1] - table.first[state]
    off = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(state)), size)
    place = np.arange(off[-1]) - off[of]
    weight = np.exp(table.log[begin[of] + place])
    gone = [(r, e) for r, edges in enumerate(left_out) for e in edges]
    r, e = (np.array([x[c] for x in gone], np.int64) for c in (0, 1))
    weight[off[r] + e - begin[r]] = 0.0
    run = np.cumsum(weight)
    run -= (run - weight)[off[:-1]][of]
    passed = np.add.reduceat((run < (u * run[off[1:] - 1])[of]).astype(np.int64), off[:-1])
    last = np.maximum.reduceat(np.where(weight > 0, place, 0), off[:-1])
    return begin + np.minimum(passed, last)


def _log_inclusion(above: float) -> float:
    """log(1 - exp(-exp(above))), also where that is too small for a double."""
    return above if above < -30 else math.log(-math.expm1(-math.exp(min(above, 30.0))))


SCHEMA = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, inclusion double, ids binary"


def sample_encodings(docs: DataFrame, model_file: str, k: int = SAMPLES, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Up to ``k`` different segmentations of every whole text, without replacement.

    A row for each: ``rank`` by perturbed log-probability, ``ids`` (32-bit, little
    endian), ``inclusion`` (and its logarithm, as long texts have tiny ones), the
    probability that the segmentation's perturbed value exceeds that of the next one
    that was not taken (1 if all were taken).  The draws
    depend on the row's id and ``seed`` alone, so equal rows have equal samples and a
    task that runs again gives the same ones.

    A null or empty text has one segmentation, of no pieces; an empty table gives no
    rows; rows that repeat a document each have their rows, all alike.  A text with fewer than
    ``k`` segmentations gives them all.  A very long text takes time and memory in
    proportion to its length, also where it is one word.  Branches whose probability is
    below e^-60 of the largest one's (``ROUNDING``) are left out, as sums in doubles can't
    tell them from nothing: a sample differs by that with a chance of 1 in 10^24 or so for
    each such branch.  ``with_text`` adds ``text``, what the ids
    decode to, without a second pass through Python (see ``decode``).
    """
    schema = f"{SCHEMA}, text string" if with_text else SCHEMA

    def sample(batches):
        table = lattice(model_file)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            keys = S.mix(np.array([-1 if i is None else i for i in ids], np.int64).view(np.uint64) + S.mix(np.array([seed + 1], np.uint64))[0])
            for part in S.chunks(texts, CHUNK):
                docs, ranks, logs, values, scores, parts = [], [], [], [], [], []
                for doc, (found, after) in zip(ids[part], top_k(texts[part], keys[part], table, k), strict=True):
                    for rank, (pieces, log, value) in enumerate(found):
                        for column, x in zip((docs, ranks, logs, values, scores, parts), (doc, rank, log, value, _log_inclusion(log - after), pieces), strict=True):
                            column.append(x)
                sizes = np.array([len(x) for x in parts], np.int64)
                flat = np.concatenate([_NO_PATH, *parts]).astype("<i4")
                columns = [
                    pa.array(docs, pa.int64()), pa.array(ranks, pa.int32()), pa.array(sizes), pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(scores, pa.float64()),
                    pa.array([math.exp(x) for x in scores], pa.float64()), _split(pa.binary(), flat.tobytes(), 4 * sizes),
                ]
                if with_text:
                    columns.append(_split(pa.string(), *spell_all(surface_table(model_file), flat, sizes)))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])
        table.clear()  # a worker that waits for its next task holds no lattices

    rows = narrow(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(sample, schema)


def spell(surface: list[bytes], ids: bytes) -> str:
    """The text of packed ids, without the blank that the encoder puts in front."""
    return b"".join(map(surface.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def surface_table(model_file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All surfaces in a row, where each begins, and its size."""
    surface = surfaces(model_file)
    size = np.array([len(x) for x in surface], np.int64)
    return np.frombuffer(b"".join(surface), np.uint8), np.cumsum(size) - size, size


def spell_all(table, flat: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``spell`` for many rows of ids at once: their texts in a row, and the bytes of each."""
    data, begin, size = table
    begin, size = begin[flat], size[flat]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    begin[first] += 1  # without the blank in front
    size[first] -= 1
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + size, size)
    total = np.concatenate([[0], stop])
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return data[at].tobytes(), total[cut[1:]] - total[cut[:-1]]


def _split(kind: pa.DataType, data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with ``text``, what its ids spell (a null or empty array: the empty text)."""
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches):
        surface = surfaces(model_file)
        for batch in batches:
            texts = [spell(surface, x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, f"{schema}, text string")


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """Digests of the samples of each document and of what they decode to."""
    found = sample_encodings(docs, model_file, with_text=True)
    return found.select("doc_id", "rank", "n_pieces", "log_prob", "log_inclusion", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("text_sha256"))


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stage(spark, docs, sf_dir):
    """The last stage: sampled segmentations of each document that is left.

    Null and empty texts have one of no pieces, repeated rows have theirs each, an empty
    table gives no rows; columns besides id and text don't matter.
    """
    return digest(docs, _model())


def query(spark, sf_dir):
    return digest(read(spark, sf_dir, "documents"), _model())
