"""Suffix sorting by linear grouping."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """The suffixes of ``symbols`` in lexicographic order; the end sorts before any symbol.

    Phase 1 groups suffixes by their Lyndon prefix.  Groups start out as the first
    symbols and are taken in descending order; each suffix of a group points to the
    nearest earlier suffix of a lower group (its previous smaller one), and what is
    pointed to by l members of the group grows by l copies of the group's prefix:
    it moves to a new group just above its old one, the more copies the higher.
    Every suffix is taken once, and groups are never renamed or sorted again.

    Phase 2 emits the order: whoever is emitted places the unplaced suffixes that
    end at it, which its previous-smaller pointers chain up, at the front of what is
    left of their groups.
    """
    n = len(symbols)
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(symbols):
        by_symbol.setdefault(x, []).append(i)
    # The end of the string is a suffix of its own, in the lowest group.
    members = [[n], *(by_symbol[x] for x in sorted(by_symbol))]
    sizes = [len(m) for m in members]
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    upper[-1] = -1
    of = [0] * (n + 1)
    for g, group in enumerate(members):
        for i in group:
            of[i] = g
    previous = [-1] * (n + 1)
    jump = list(range(-1, n))  # leads past suffixes that were taken already
    taken = bytearray(n + 1)
    g = len(members) - 1
    while g >= 0:
        group = [i for i in members[g] if of[i] == g]  # the others have moved up
        for i in group:
            taken[i] = 1
        counts: dict[int, int] = {}
        for i in group:
            j = i - 1
            if j >= 0 and taken[j]:
                first = j
                while j >= 0 and taken[j]:
                    j = jump[j]
                while first != j:
                    jump[first], first = j, jump[first]
            previous[i] = jump[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        kinds = set(counts.values())
        for copies in sorted(kinds, reverse=True):
            growing: dict[int, list[int]] = {}
            for j, c in counts.items():
                if c == copies:
                    if of[j] in growing:
                        growing[of[j]].append(j)
                    else:
                        growing[of[j]] = [j]
            for old, moved in growing.items():
                if len(moved) == sizes[old]:
                    continue  # what is left of the group grows alike, and stays in its place
                new, above = len(members), upper[old]
                members.append(moved)
                sizes.append(len(moved))
                sizes[old] -= len(moved)
                lower.append(old)
                upper.append(above)
                lower[above], upper[old] = new, new
                for j in moved:
                    of[j] = new
        g = lower[g]
    front = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        front[g] = at
        at += sizes[g]
        g = upper[g]
    order = [n] * (n + 1)
    placed = bytearray(n + 1)
    placed[n] = 1
    for at in range(n + 1):
        i = order[at] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = of[i]
            order[front[g]] = i
            front[g] += 1
            i = previous[i]
    return order[1:]
