"""Exact groups of mutually similar vectors among candidates in memory."""

from __future__ import annotations

import numpy as np

BLOCK = 1024


def leaders(x: np.ndarray, cos: float) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, row of each group's leader): in row order, a row joins the first leader of at least ``cos``, or leads.
    x: rows of norm 1. Where groups are cliques apart from each other, these are the groups."""
    n = len(x)
    group = np.full(n, -1, np.int64)
    lead: list[int] = []
    lx = np.empty((0, x.shape[1]))
    for s in range(0, n, BLOCK):
        b = x[s : s + BLOCK]
        g = np.full(len(b), -1, np.int64)
        for t in range(0, len(lx), 4096):
            m = b @ lx[t : t + 4096].T >= cos
            hit = m.any(1) & (g < 0)
            g[hit] = m[hit].argmax(1) + t
        left = np.flatnonzero(g < 0)
        if len(left):
            near = b[left] @ b[left].T >= cos
            near[np.arange(len(left)), np.arange(len(left))] = True
            free = np.ones(len(left), bool)
            new = []
            for i in range(len(left)):
                if free[i]:
                    mine = free & near[i]
                    g[left[mine]] = len(lead)
                    free &= ~mine
                    lead.append(s + int(left[i]))
                    new.append(left[i])
            lx = np.vstack([lx, b[new]])
        group[s : s + BLOCK] = g
    return group, np.array(lead, np.int64)


def components(x: np.ndarray, cos: float) -> list[tuple[np.ndarray, bool]]:
    """(rows, whether every two of them are near) of the connected parts of the graph of pairs of at least ``cos``. Rows are in order, parts by
    their first row."""
    group, lead = leaders(x, cos)
    top = np.arange(len(lead))  # of groups; a group is connected by its leader

    def root(g: int) -> int:
        while top[g] != g:
            top[g] = top[top[g]]
            g = top[g]
        return g

    near = np.zeros(len(x), np.int64)
    step = max(1, (1 << 22) // max(1, len(x)))
    for s in range(0, len(x), step):
        m = x[s : s + step] @ x.T >= cos
        m[np.arange(len(m)), np.arange(s, s + len(m))] = True
        near[s : s + step] = m.sum(1)
        i, j = np.nonzero(m)
        cross = group[i + s] != group[j]
        for a, b in np.unique(np.stack([group[i[cross] + s], group[j[cross]]], 1), axis=0).tolist():
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    part = np.array([root(g) for g in range(len(lead))], np.int64)[group]
    o = np.argsort(part, kind="stable")
    rows = np.split(o, np.flatnonzero(np.diff(part[o])) + 1) if len(o) else []
    return [(r, bool((near[r] == len(r)).all())) for r in rows]


def set_members(x: np.ndarray, weight: np.ndarray, cos: float, least: int) -> list[tuple[int, np.ndarray]]:
    """(first row, rows) of the maximal sets of rows of which every two score at least ``cos``, of a weight of ``least`` or more: for each row the
    rows that are with it in a set that it is the first of. No set is left out, but sets of one first row are given together. Parts that are
    cliques, the rule, cost nothing more; in others a search for each row stops at the first set that holds it."""
    out = []
    for rows, clique in components(x, cos):
        if weight[rows].sum() < least:
            continue
        if clique:
            out.append((int(rows[0]), rows))
        else:
            out += [(int(rows[c]), rows[np.array(m)]) for c, m in overlapping(x[rows] @ x[rows].T >= cos, weight[rows], least)]
    return out


def overlapping(near: np.ndarray, weight: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """``set_members`` of one part, by its matrix of near pairs. Sets of rows are the bits of whole numbers."""
    n = len(near)
    near = near | np.eye(n, dtype=bool)
    nb = [int.from_bytes(np.packbits(r, bitorder="little").tobytes(), "little") & ~(1 << i) for i, r in enumerate(near)]
    w = weight.tolist()
    even = min(w) == max(w) == 1

    def bits(m: int) -> list[int]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(m.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()

    def total(m: int) -> int:
        return m.bit_count() if even else sum(w[v] for v in bits(m))

    def reaches(may: int, need: int) -> bool:
        """Whether ``may`` can give so much weight: of rows that are far from each other, one."""
        while may and need > 0:
            heaviest, far = 0, may
            while far:
                u = (far & -far).bit_length() - 1
                heaviest, may, far = max(heaviest, w[u]), may & ~(1 << u), far & ~nb[u] & ~(1 << u)
            need -= heaviest
        return need <= 0

    def search(taken: int, may: int, done: int) -> int:
        """A maximal set of enough weight that holds ``taken`` and none of ``done``, which could all join it; 0 if there is none. Rows that can only be
        taken one way are; a stack holds what else to try."""
        todo = [(taken, may, done)]
        while todo:
            taken, may, done = todo.pop()
            if total(taken | may) < least or not reaches(may, least - total(taken)):
                continue
            rivals, few = None, n + 1
            for u in bits(done):  # each of these must have a rival in the set
                r = may & ~nb[u]
                if r.bit_count() < few:
                    rivals, few = r, r.bit_count()
                    if few <= 1:
                        break
            if few == 0:
                continue
            if rivals is None:
                if not may:
                    return taken
                # Rows near to all that may come are in every set; else one that is near to most, or one of its rivals.
                near_to = {u: (nb[u] & may).bit_count() for u in bits(may)}
                sure = [u for u, m in near_to.items() if m == len(near_to) - 1]
                if sure:
                    for u in sure:
                        taken, may = taken | 1 << u, may & ~(1 << u)
                    todo.append((taken, may, done))
                    continue
                v = max(near_to, key=near_to.get)
                choice = [v, *bits(may & ~nb[v] & ~(1 << v))]
            else:
                choice = sorted(bits(rivals), key=lambda u: -(nb[u] & may).bit_count())
            branches = []
            for v in choice:
                branches.append((taken | 1 << v, may & nb[v], done & nb[v]))
                may, done = may & ~(1 << v), done | 1 << v
            todo += branches[::-1]
        return 0

    out = []
    for c in range(n):
        before = nb[c] & ((1 << c) - 1)
        may = nb[c] & ~before
        found = search(1 << c, may, before)
        if not found:
            continue
        for v in bits(may & ~found):
            if not found >> v & 1:
                found |= search(1 << c | 1 << v, may & nb[v], before & nb[v])
        out.append((c, bits(found)))
    return out
