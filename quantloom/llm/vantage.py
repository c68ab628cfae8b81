"""Vantage-point trees over 64-bit fingerprints: all links within a Hamming radius.

A node splits its fingerprints by their distance to a vantage point, one of them, into an inner and an
outer shard. By the triangle inequality a pair within `radius` that lies on both sides has its outer member
within `radius` of the boundary, so just those go along into the inner shard as visitors; any other
visit is pruned. The boundary is put where the fewest pairs remain to be compared, and a shard for which no
boundary spares any is a leaf, as is a small one. Members of a leaf are compared with each other and
with its visitors in full.

A shard gives a spanning forest of its links, never all pairs, so output is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Members of a leaf that is not split, and of one that is compared as a matrix.
LEAF, MATRIX = 32, 1024
#: A split must leave less than this share of the pairs.
WORTH = 0.95


@dataclass
class Tally:
    """What a search did: nodes split, leaves, visits across a boundary, and visits that it pruned."""

    nodes: int = 0
    leaves: int = 0
    visits: int = 0
    pruned: int = 0


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _boundary(members: np.ndarray, guests: np.ndarray, radius: int) -> int | None:
    """The largest inner distance that leaves the fewest pairs, given the distances of members and guests;
    None if no boundary is worth it."""
    n, g = (np.cumsum(np.bincount(x, minlength=65 + radius)) for x in (members, guests))
    at = np.arange(64)
    inner, outer = n[at], n[-1] - n[at]
    into_inner = g[at + radius] + n[at + radius] - n[at]
    into_outer = g[-1] - np.where(at >= radius, g[at - radius], 0)
    pairs = inner * (inner / 2 + into_inner) + outer * (outer / 2 + into_outer)
    pairs[(inner == 0) | (outer == 0)] = np.inf
    best = int(pairs.argmin())
    return best if pairs[best] < WORTH * n[-1] * (n[-1] / 2 + g[-1]) else None


def leaves(fps: np.ndarray, radius: int, leaf: int = LEAF, tally: Tally | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, visitors) index sets: each index is a member once, and every pair within the radius is
    together in a leaf of which one of them at least is a member."""
    tally = tally or Tally()
    todo = [(np.arange(len(fps)), np.zeros(0, np.int64))]
    while todo:
        members, guests = todo.pop()
        found = None
        if len(members) > leaf:
            for turn in range(2):  # a second vantage point, as far from the first as can be, if the first is no good
                vantage = members[len(members) // 2] if not turn else members[int(d.argmax())]
                d, g = distance(fps[members], fps[vantage]), distance(fps[guests], fps[vantage])
                if (found := _boundary(d, g, radius)) is not None:
                    break
        if found is None:
            tally.leaves += 1
            yield members, guests
            continue
        inside, over = d <= found, (d > found) & (d <= found + radius)
        to_inner, to_outer = g <= found + radius, g > found - radius if radius <= found else np.ones(len(g), bool)
        tally.nodes += 1
        tally.visits += int(over.sum() + to_inner.sum() + to_outer.sum())
        tally.pruned += int((~inside & ~over).sum() + (~to_inner).sum() + (~to_outer).sum())
        todo.append((members[inside], np.concatenate([guests[to_inner], members[over]])))
        todo.append((members[~inside], guests[to_outer]))


def breadth_first(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links: a member is compared with those that are not yet reached only, so a
    dense group takes linear time."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = distance(fps[left], fps[k]) <= radius
            reached = left[near].tolist()
            left = left[~near]
            queue += reached
            edges += [(k, x) for x in reached]
    return edges


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those edges that join what the ones before them left apart."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for a, b in edges:
        if (x := top(a)) != (y := top(b)):
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _leaf_links(fps: np.ndarray, members: np.ndarray, guests: np.ndarray, radius: int) -> list[tuple[int, int]]:
    at = np.concatenate([members, guests])
    if len(members) <= MATRIX:
        step, found, links = max(1, (1 << 22) // len(at)), [], 0
        for k in range(0, len(members), step):
            a, b = np.nonzero(distance(fps[members[k : k + step], None], fps[at]) <= radius)
            a += k
            found.append(np.stack([a, b], 1)[a < b])
            if (links := links + len(found[-1])) > 8 * len(at):
                break
        else:
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            return np.stack([at[pairs[:, 0]], at[pairs[:, 1]]], 1).tolist()
    return [(int(at[a]), int(at[b])) for a, b in breadth_first(fps[at], radius)]


def links(fps: np.ndarray, radius: int, leaf: int = LEAF, tally: Tally | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, as pairs of indices."""
    found = []
    for members, guests in leaves(fps, radius, leaf, tally):
        found += _leaf_links(fps, members, guests, radius)
    return spanning(found)


def leaf_links(keys: np.ndarray, fps: np.ndarray, radius: int, size: int = LEAF) -> list[tuple[int, int]]:
    """The same for many shards of up to `size` rows, each a leaf: rows sorted by key, compared at growing shifts."""
    found = []
    for shift in range(1, size):
        same = np.flatnonzero(keys[:-shift] == keys[shift:])
        if not len(same):
            break
        hit = same[distance(fps[same], fps[same + shift]) <= radius]
        found.append(np.stack([hit, hit + shift], 1))
    return spanning(np.concatenate(found).tolist()) if found else []
