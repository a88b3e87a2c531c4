"""Sequence alignment and assignment kernels, in numpy, for grouped functions."""

from __future__ import annotations

import itertools

import numpy as np


def _coded(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    number: dict[str, int] = {}
    return tuple(np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in (ref, hyp))


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Word-level Levenshtein alignment as (op, i, j), op one of C S D I.

    Rows of the table are computed at once (insertions by a running minimum) and kept as two bits for
    each cell. Ties go to the diagonal, then to a deletion, then to an insertion, from the end backwards.
    """
    a, b = _coded(ref, hyp)
    n, m = len(a), len(b)
    row = np.arange(m + 1)
    move = np.zeros((n + 1, -(-(m + 1) // 4)), np.uint8)
    cols = np.arange(m + 1)

    def keep(i: int, moves: np.ndarray) -> None:
        padded = np.zeros(move.shape[1] * 4, np.uint8)
        padded[: m + 1] = moves
        q = padded.reshape(-1, 4)
        move[i] = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6

    keep(0, np.full(m + 1, 2, np.uint8))
    for i in range(1, n + 1):
        diagonal = np.append(i, row[:-1] + (b != a[i - 1]))
        up = row + 1
        best = np.minimum(up, diagonal)
        new = np.minimum.accumulate(best - cols) + cols
        keep(i, np.where((new == diagonal) & (cols > 0), 0, np.where(new == up, 1, 2)).astype(np.uint8))
        row = new
    out, i, j = [], n, m
    while i or j:
        k = int(move[i, j >> 2] >> 2 * (j & 3) & 3)
        if k == 0 and i and j:
            i, j = i - 1, j - 1
            out.append(("C" if a[i] == b[j] else "S", i, j))
        elif i and (k == 1 or not j):
            i -= 1
            out.append(("D", i, None))
        else:
            j -= 1
            out.append(("I", None, j))
    return out[::-1]


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions, insertions."""
    ops = [op for op, _, _ in align(ref, hyp)]
    return tuple(ops.count(x) for x in "CSDI")


def distance(ref: list[str], hyp: list[str]) -> int:
    a, b = _coded(ref, hyp)
    row, cols = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a):
        best = np.minimum(row + 1, np.append(i + 1, row[:-1] + (b != x)))
        row = np.minimum.accumulate(best - cols) + cols
    return int(row[-1])


def distance_within(ref: list[str], hyp: list[str], most: int) -> int | None:
    """The distance if it is at most ``most``, else None: by a band that doubles until it holds the answer."""
    a, b = _coded(ref, hyp)
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(unlike[0]) if len(unlike) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    # words that one side has more of need a change each
    more = np.bincount(a, minlength=int(max(a.max(initial=0), b.max(initial=0))) + 1)
    more = more - np.bincount(b, minlength=len(more))
    if max(int(more[more > 0].sum()), int(-more[more < 0].sum())) > most:
        return None
    k = min(max(16, abs(n - m)), most)
    while True:
        far, off = n + m + 1, np.arange(2 * k + 1)
        padded = np.full(n + m + 4 * k + 2, -1, np.int64)
        padded[k : k + m] = b
        row = np.where((off >= k) & (off <= k + m), off - k, far)
        for i in range(1, n + 1):
            j = off + i - k
            best = row + (padded[i - 1 : i + 2 * k] != a[i - 1])
            best[:-1] = np.minimum(best[:-1], row[1:] + 1)
            best[(j < 0) | (j > m)] = far
            row = np.minimum.accumulate(best - off) + off
            row[(j < 0) | (j > m)] = far
        found = int(row[m - n + k])
        if found <= k:
            return found
        if k >= most:
            return None
        k = min(2 * k, most)


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row at the least total cost: shortest augmenting paths, n cubed; ties to the left."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if n > m:
        rows = assign(cost.T)
        out = np.full(n, -1)
        out[rows] = np.arange(m)
        return out
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, back = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least = np.full(m + 1, np.inf)
        done = np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            r = owner[at]
            free = ~done[1:]
            now = cost[r - 1] - u[r] - v[1:]
            better = free & (now < least[1:])
            least[1:][better] = now[better]
            back[1:][better] = at
            step = np.where(free, least[1:], np.inf)
            nxt = int(step.argmin()) + 1
            delta = step[nxt - 1]
            u[owner[done]] += delta
            v[done] -= delta
            least[1:][free] -= delta
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assign_brute(cost: np.ndarray) -> float:
    """The least total by trying every permutation; for tests."""
    n, m = cost.shape
    if n > m:
        return assign_brute(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def cp_counts(ref: dict[str, list[str]], hyp: dict[str, list[str]]) -> tuple[tuple[int, int, int, int], dict[str, str]]:
    """Counts under the best mapping of hypothesis speakers to reference speakers, and that mapping."""
    r, h = sorted(ref), sorted(hyp)
    k = max(len(r), len(h))
    cells = [[edit_counts(ref[r[i]] if i < len(r) else [], hyp[h[j]] if j < len(h) else []) for j in range(k)] for i in range(k)]
    cost = np.array([[s + d + ins for _, s, d, ins in row] for row in cells], float).reshape(k, k)
    cols = assign(cost) if k else []
    total = tuple(sum(cells[i][j][c] for i, j in enumerate(cols)) for c in range(4))
    return total, {h[j]: r[i] for i, j in enumerate(cols) if i < len(r) and j < len(h)}


def speaker_errors(ref: list[tuple[str, str]], hyp: list[tuple[str, str]], mapping: dict[str, str]) -> tuple[int, int]:
    """Of matched or substituted words of the flat streams: those with the wrong speaker, and all."""
    wrong = total = 0
    for op, i, j in align([w for w, _ in ref], [w for w, _ in hyp]):
        if op in "CS":
            total += 1
            wrong += mapping.get(hyp[j][1], hyp[j][1]) != ref[i][1]
    return wrong, total


def shared_runs(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Matching blocks of the longest-first recursion, of that many words or more."""
    import difflib

    found = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return [(x.a, x.b, x.size) for x in found if x.size >= least]
