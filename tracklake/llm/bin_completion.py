"""Bin completion: few bins for many items, by branch and bound over how the bin of the largest item is filled.

Items are counted by length, so that a bin's filling can be given to many bins at once and the work depends on how many lengths there are, not on how
many items. A packing is a list of (pattern, times); a pattern has the lengths of one bin, in descending order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np

Packing = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Packing:
    """Best-fit decreasing: each item, from the largest, goes to the fullest bin that has room for it. counts[n] are the items of length n."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by their room
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((pattern, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), -(-left // (capacity // n))
            # the bin stays the fullest with room until nothing more fits
            each = room // n
            full = min(times, left // each)
            put(room - each * n, pattern + (n,) * each, full)
            left -= full * each
            if full < times and left:
                put(room - left * n, pattern + (n,) * left, 1)
                left, full = 0, full + 1
            if pattern:
                put(room, pattern, times - full)
    return [b for room in rooms for b in bins[room]]


def fewest(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: for each least length k, items that leave no room for k have bins of their own, and what does
    not fit beside other large items has to be put into more."""
    n = np.arange(len(counts))
    many, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * n)])
    half = capacity // 2
    k = np.arange(half + 1)
    alone = many[-1] - many[capacity - k + 1]  # longer than capacity - k
    beside = many[capacity - k + 1] - many[half + 1]  # over one half, up to that
    room = beside * capacity - (mass[capacity - k + 1] - mass[half + 1])
    small = mass[half + 1] - mass[k]
    return int((alone + beside + np.maximum(0, -(-(small - room) // capacity))).max())


def fillings(counts: np.ndarray, room: int, spare: int, width: int, steps: int = 4_000) -> list[tuple[int, ...]]:
    """At most `width` undominated ways to fill a bin's room, the tightest first, none that wastes more than `spare`.

    An item that fills the room exactly is as good as anything. Else a filling is dominated, and left out, if a longer item could take the place of one
    or two of its items: the other packing could swap them and be no worse. After `steps` steps what was found is returned, with the filling by the
    largest item that fits, again and again; small tables don't need so many.
    """
    if room == 0 or room < len(counts) and counts[room]:
        return [(room,) if room else ()]
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    if not lengths:
        return [()] if room <= spare else []
    most = {n: int(counts[n]) for n in lengths}
    reach = 1  # bit s: lengths can be added up to s, if there were enough of each
    for n in lengths:
        step = n
        while step <= room:
            reach |= reach << step
            step *= 2
    found: list[tuple[int, ...]] = []

    def fill(left: int, at: int, taken: list[int]) -> Iterator[tuple[int, ...]]:
        nonlocal steps
        if left == 0:
            yield tuple(taken)
            return
        for i in range(bisect_left(lengths, -left, lo=at, key=lambda n: -n), len(lengths)):
            steps -= 1
            if steps < 0:
                return
            n = lengths[i]
            if reach >> (left - n) & 1 and taken.count(n) < most[n]:
                taken.append(n)
                yield from fill(left - n, i, taken)
                taken.pop()

    for waste in range(min(spare, room) + 1):
        if reach >> (room - waste) & 1:
            for f in fill(room - waste, 0, []):
                if not waste or not _dominated(f, waste, most):
                    found.append(f)
                    if len(found) == width:
                        return found
        if steps < 0:
            greedy, left = [], room
            for n in lengths:
                k = min(most[n], left // n)
                greedy += [n] * k
                left -= k * n
            return found if tuple(greedy) in found or left > spare else [*found, tuple(greedy)]
    return found


def _dominated(filling: tuple[int, ...], waste: int, most: dict[int, int]) -> bool:
    own = Counter(filling)

    def longer(n: int, least: int) -> bool:
        """Whether an item of at least `least`, other than those of the filling, fits into the place of n with the waste."""
        return any(most.get(m, 0) > own[m] for m in range(least, n + waste + 1))

    if longer(0, 1):  # there is room for one more
        return True
    return any(longer(n, n + 1) for n in own) or any(longer(a + b, a + b) for i, a in enumerate(filling) for b in filling[i + 1 :])


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 1_000, width: int = 12, every: int = 32) -> Packing:
    """Items in as few bins as are found: counts[n] items of length n, 1 <= n <= capacity.

    Branches are the fillings of the bin that holds the largest item left, each given to as many such bins as there are items for, then to fewer. A branch is
    cut when its waste, or the least number of bins for what is left, can't beat the best packing known (the incumbent). The first incumbent is
    best-fit decreasing; at every `every` nodes the branch's remaining items are packed by best fit, and the better packing becomes the
    incumbent. The search ends when no packing can be better, or after `nodes` nodes: small tables get an optimum, large ones the best that was met.
    """
    left = np.array(counts, np.int64)
    if len(left) <= capacity:
        left = np.concatenate([left, np.zeros(capacity + 1 - len(left), np.int64)])
    assert left[0] == 0 and len(left) == capacity + 1
    total = int((left * np.arange(capacity + 1)).sum())
    best, least = best_fit(left, capacity), fewest(left, capacity)
    bins = sum(t for _, t in best)
    path: Packing = []
    used = waste = 0

    def branches() -> Iterator[tuple[tuple[int, ...], int]]:
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        found = fillings(left, capacity - top, (bins - 1) * capacity - total - waste, width)
        left[top] += 1
        for f in found:
            pattern = (top, *f)
            most = min(int(left[n]) // k for n, k in Counter(pattern).items())
            yield from ((pattern, t) for t in sorted({most, *range(1, min(most, 8)), -(-most // 2)}, reverse=True))

    def give(pattern: tuple[int, ...], times: int) -> None:
        nonlocal used, waste
        for n in pattern:
            left[n] -= times
        used, waste = used + times, waste + times * (capacity - sum(pattern))

    open_nodes = [branches()] if total else []
    while open_nodes and bins > least and nodes > 0:
        step = next(open_nodes[-1], None)
        if step is None:
            open_nodes.pop()
            if path:
                pattern, times = path.pop()
                give(pattern, -times)
            continue
        nodes -= 1
        give(*step)
        path.append(step)
        done = not left.any()
        if done or nodes % every == 0:
            rest = best_fit(left, capacity)
            if (found := used + sum(t for _, t in rest)) < bins:
                best, bins = path + rest, found
        if done or used + fewest(left, capacity) >= bins or waste > (bins - 1) * capacity - total:
            path.pop()
            give(step[0], -step[1])
        else:
            open_nodes.append(branches())
    return best
