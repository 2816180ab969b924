"""The best ratio of matching blocks between two lists of names, without working out most of them."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: First names that are looked at together, and second names whose index is kept.
TOGETHER, KEPT_NAMES = 256, 5000
#: Letters by which pairs may be below the most that a first name has in common with any, to be looked at first.
LESS = 1
#: Characters of a first name up to which common subsequences are counted (bits of a word).
WORD = 64
_ONE = np.uint64(1)


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of names; and the name, place and code of each of their letters."""
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return lengths, np.repeat(np.arange(len(names)), lengths), np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), codes


class Second:
    """Second names, in order of preference, as the counts and places of their letters."""

    def __init__(self, names: list[str]):
        self.names = names
        self.lengths, name, place, codes = _letters(names)
        self.alphabet, letter = np.unique(codes, return_inverse=True)
        self.none = len(self.alphabet)  # stands for no letter
        self.places = np.full((int(self.lengths.max()), len(names)), self.none, dtype=np.int64)
        self.places[place, name] = letter
        counts = np.zeros((self.none, len(names)), dtype=np.uint8 if self.lengths.max() < 256 else np.uint32)
        np.add.at(counts, (letter, name), 1)
        # Letters that all have as often count once for all.
        moves = counts.min(axis=1) != counts.max(axis=1)
        self.moving, self.fixed = [(k, counts[k]) for k in np.flatnonzero(moves)], [(k, counts[k, 0]) for k in np.flatnonzero(~moves)]
        self.kind = counts.dtype
        self.by_length = [(n, np.flatnonzero(self.lengths == n)) for n in np.unique(self.lengths)]
        same = self.places[: int(self.lengths.min())] == self.places[: int(self.lengths.min()), :1]
        self.alike = self.places[: int(np.r_[same.all(axis=1), False].argmin()), 0]  # how all begin
        self.kept: dict[int, SequenceMatcher] = {}

    def ratio(self, a: str, j: int) -> float:
        """U1 of a first name and the second name ``j``; its index serves for many first ones."""
        if j not in self.kept:
            if len(self.kept) >= KEPT_NAMES:
                self.kept.clear()
            self.kept[j] = SequenceMatcher(None, "", self.names[j])
        self.kept[j].set_seq1(a)
        return self.kept[j].ratio()


class _First:
    """Some first names against ``Second``: what each pair has in common at most."""

    def __init__(self, names: list[str], second: Second):
        self.names, self.second = names, second
        self.lengths, name, place, codes = _letters(names)
        at = np.minimum(np.searchsorted(second.alphabet, codes), second.none - 1)
        letter = np.where(second.alphabet[at] == codes, at, second.none)
        counts = np.zeros((len(names), second.none + 1), dtype=np.int64)
        np.add.at(counts, (name, letter), 1)
        counts = np.minimum(counts, np.iinfo(second.kind).max).astype(second.kind)
        self.common = np.zeros((len(names), len(second.names)), dtype=second.kind)
        for k, held in second.moving:
            self.common += np.minimum(counts[:, k : k + 1], held)
        always = np.zeros((len(names), 1), dtype=second.kind)
        for k, held in second.fixed:
            always += np.minimum(counts[:, k : k + 1], held)
        self.common += always
        # What all names on both sides begin with is in common anyway.
        self.head = 0
        while self.head < min(len(second.alike), int(self.lengths.min())) and (letter[place == self.head] == second.alike[self.head]).all():
            self.head += 1
        self.width, self.bits = second.none + 1, self.lengths - self.head
        self.masks = np.zeros(len(names) * self.width, dtype=np.uint64)
        inside = (self.bits <= WORD)[name] & (letter < second.none) & (place >= self.head)
        np.bitwise_or.at(self.masks, (name * self.width + letter)[inside], np.left_shift(_ONE, (place[inside] - self.head).astype(np.uint64)))

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No ratio is above twice the longest common subsequence over all letters (of long first names: above twice the letters in common)."""
        second, start = self.second, i * self.width
        open_ = np.full(len(i), ~np.uint64(0))
        for place in range(self.head, int(second.lengths[j].max()) if len(j) else 0):
            hit = open_ & self.masks.take(start + second.places[place].take(j))
            open_ = (open_ + hit) | (open_ - hit)
        bits = self.bits[i]
        inside = np.where(bits < WORD, np.left_shift(_ONE, np.minimum(bits, WORD - 1).astype(np.uint64)) - _ONE, ~np.uint64(0))
        longest = np.where(bits <= WORD, self.head + np.bitwise_count(~open_ & inside).astype(np.int64), self.common[i, j])
        return 2.0 * longest / (self.lengths[i] + second.lengths[j])

    def at_least(self, ratios: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose letters (and ``less`` more of them) allow the ratio asked of the first name, or more."""
        found = []
        for n, js in self.second.by_length:
            # The least number of letters whose ratio is not below.
            need = np.floor(ratios * (self.lengths + n) / 2)
            need = np.where(2.0 * need / (self.lengths + n) < ratios, need + 1, need)
            need = np.clip(need - less, 0, np.iinfo(self.second.kind).max).astype(self.second.kind)
            i, k = np.nonzero((self.common if len(js) == len(self.second.names) else self.common[:, js]) >= need[:, None])
            found.append((i, js[k]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return i, j

    def highest(self) -> np.ndarray:
        """The highest ratio that the letters of each first name allow."""
        top = np.zeros(len(self.names))
        for n, js in self.second.by_length:
            np.maximum(top, 2.0 * self.common[:, js].max(axis=1) / (self.lengths + n), out=top)
        return top


def best_ratios(first: list[str], second: list[str], above: float) -> tuple[np.ndarray, np.ndarray]:
    """For each first name the second one of the highest ratio above ``above``, and the ratio; -1 where none is.

    Of equal ratios the earlier second name wins.  Names must not be empty.  A pair is
    compared only if its letters, and then its longest common subsequence, allow it to
    win over the best so far, so the result is that of all pairs.
    """
    held = Second(second)
    at, top = np.full(len(first), -1, dtype=np.int64), np.full(len(first), above)

    def settle(names, base, i, j, bound):
        order = np.lexsort((j, -bound, i))
        for k, n, x in zip(i[order].tolist(), j[order].tolist(), bound[order].tolist(), strict=True):
            now, best = at[base + k], top[base + k]
            if x < best or (x == best and (now < 0 or n > now)):
                continue
            ratio = held.ratio(names[k], n)
            if ratio > best or (ratio == best and now >= 0 and n < now):
                at[base + k], top[base + k] = n, ratio

    for base in range(0, len(first), TOGETHER):
        names = first[base : base + TOGETHER]
        some = _First(names, held)
        # The best of what the letters put first sets the mark for all others.
        i, j = some.at_least(np.maximum(some.highest(), above), less=LESS)
        bound = some.bounds(i, j)
        order = np.lexsort((j, -bound, i))
        lead = order[np.flatnonzero(np.r_[True, np.diff(i[order]) > 0])] if len(i) else order
        settle(names, base, i[lead], j[lead], bound[lead])
        i, j = some.at_least(top[base : base + len(names)])
        alike = 2.0 * some.common[i, j] / (some.lengths[i] + held.lengths[j]) == top[base + i]
        i, j = i[~alike | (j < at[base + i])], j[~alike | (j < at[base + i])]
        bound = some.bounds(i, j)
        mark, now = top[base + i], at[base + i]
        worth = (bound > mark) | ((bound == mark) & (j < now))
        settle(names, base, i[worth], j[worth], bound[worth])
    return at, top
