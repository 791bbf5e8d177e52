"""Singular values and right vectors of a small upper triangular matrix.

Householder reflections make it bidiagonal, dqds finds all singular values to
high relative accuracy, and each right vector wanted comes from a twisted
factorisation. Where eigenvalues of B'B lie close together, the factored matrix
is shifted next to them first, which sets them apart (relatively robust
representations), so vectors of a cluster come out orthogonal.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = 1e-290
#: closer than this (relative to their size) eigenvalues are shifted apart first
APART = 1e-3


def _reflector(x: np.ndarray):
    """(v, beta, alpha): (I - beta v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -math.copysign(norm, x[0])
    v = x / norm
    v[0] -= alpha / norm
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray):
    """(diagonal, superdiagonal, V) with r = U B V'."""
    a, d = np.array(r, dtype=np.float64), r.shape[1]
    right = np.eye(d)
    for k in range(d):
        v, beta, alpha = _reflector(a[k:, k].copy())
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
            a[k, k], a[k + 1 :, k] = alpha, 0.0
        if k < d - 2:
            v, beta, alpha = _reflector(a[k, k + 1 :].copy())
            if beta:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
                right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, beta * v)
                a[k, k + 1], a[k, k + 2 :] = alpha, 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list, e: list, shift: float):
    """One sweep: the arrays shifted by ``shift``, the least intermediate value; None if the shift was too large."""
    m = len(q)
    qq, ee = [0.0] * m, [0.0] * (m - 1)
    d = least = q[0] - shift
    for i in range(m - 1):
        if d < 0.0:
            return None
        qq[i] = d + e[i]
        if qq[i] <= 0.0:  # nothing left here: the next one starts anew
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / qq[i]
            ee[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0.0:
        return None
    qq[-1] = d
    return qq, ee, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Eigenvalues of B'B by the differential quotient-difference algorithm with shifts, falling."""
    found: list[float] = []
    scale = max([*np.abs(diagonal), *np.abs(above)], default=0.0)
    if scale == 0.0:
        return [0.0] * len(diagonal)
    stack = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    tol = (8 * EPS) ** 2
    while stack:
        q, e, sigma = stack.pop()
        tried = 0.0
        while q:
            m = len(q)
            if m == 1:
                found.append(sigma + q[0])
                break
            cut = next((i for i in range(m - 1) if e[i] <= tol * (sigma + min(q[i], q[i + 1]))
                        or e[i] <= tol * sigma or e[i] < TINY), None)
            if cut is not None:  # the two sides share no entry: solve each
                stack.append((q[cut + 1 :], e[cut + 1 :], sigma))
                q, e, tried = q[: cut + 1], e[:cut], 0.0
                continue
            if q[0] < q[-1]:  # large values first: the small end converges
                q, e = q[::-1], e[::-1]
            done = _dqds(q, e, tried) if tried > 0.0 else None
            while done is None:
                tried = tried * 0.25 if tried > TINY and tried > sigma * EPS else 0.0
                done = _dqds(q, e, tried)
                if tried == 0.0:
                    break
            q, e, least = done
            sigma += tried
            tried = max(0.0, least * (1 - 1e-9)) if least > 0 else 0.0
    return sorted((x * scale * scale for x in found), reverse=True)


def _stationary(low, dia, shift):
    """L+ D+ L+' = L D L' - shift: (L+, D+, s)."""
    m = len(dia)
    lo, di, s = np.zeros(max(m - 1, 0)), np.zeros(m), np.zeros(m)
    s[0] = -shift
    for i in range(m - 1):
        di[i] = s[i] + dia[i]
        if di[i] == 0.0:
            di[i] = -EPS * abs(dia[i]) or -TINY
        lo[i] = dia[i] * low[i] / di[i]
        s[i + 1] = lo[i] * low[i] * s[i] - shift
    di[-1] = s[-1] + dia[-1]
    return lo, di, s


def _progressive(low, dia, shift):
    """U- D- U-' = L D L' - shift, from below: (U-, p)."""
    m = len(dia)
    up, p = np.zeros(max(m - 1, 0)), np.zeros(m)
    p[-1] = dia[-1] - shift
    for i in range(m - 2, -1, -1):
        pivot = dia[i] * low[i] * low[i] + p[i + 1]
        if pivot == 0.0:
            pivot = -EPS * abs(dia[i + 1]) or -TINY
        t = dia[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - shift
    return up, p


def _below(low, dia, x) -> int:
    """How many eigenvalues of L D L' are below x."""
    return int(np.count_nonzero(_stationary(low, dia, x)[1] < 0))


def _bisected(low, dia, number: int, least: float, most: float) -> float:
    """The eigenvalue with ``number`` others below it, to high relative accuracy."""
    width = max(abs(least), abs(most)) * EPS + TINY
    while _below(low, dia, least) > number:
        least, width = least - width, 2 * width
    while _below(low, dia, most) <= number:
        most, width = most + width, 2 * width
    for _ in range(400):
        middle = 0.5 * (least + most)
        if most - least <= 2 * EPS * max(abs(least), abs(most)) or middle in (least, most):
            break
        if _below(low, dia, middle) > number:
            most = middle
        else:
            least = middle
    return 0.5 * (least + most)


def _twisted(low, dia, value, avoid=()):
    """The vector of an eigenvalue of L D L': of all twists the one with the least residual."""
    best = None
    for _ in range(4):
        lo, di, s = _stationary(low, dia, value)
        up, p = _progressive(low, dia, value)
        gamma = s + p + value
        gamma[-1] = di[-1]
        order = np.argsort(np.abs(gamma), kind="stable")
        r = int(next((i for i in order if i not in avoid), order[0]))
        z = np.zeros(len(dia))
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lo[i] * z[i + 1]
            if z[i] == 0.0 and z[i + 1] == 0.0:
                break
        for i in range(r, len(dia) - 1):
            z[i + 1] = -up[i] * z[i]
            if z[i + 1] == 0.0:
                break
        norm = float(np.linalg.norm(z))
        rest = abs(gamma[r]) / norm
        if best is not None and rest >= best[0]:
            break
        best = (rest, z / norm, r)
        value += gamma[r] / norm**2  # the Rayleigh quotient
    return best[1], best[2]


def _vectors(low, dia, values: list[float], numbers: list[int], wanted: set[int], depth: int = 0) -> dict[int, np.ndarray]:
    """number -> vector, for the ``wanted`` ones among eigenvalues (falling, ``numbers`` in the whole) of L D L'."""
    out: dict[int, np.ndarray] = {}
    at = 0
    while at < len(values):
        to = at + 1
        while to < len(values) and values[to - 1] - values[to] < APART * max(abs(values[to - 1]), abs(values[to])):
            to += 1
        group, ids = values[at:to], numbers[at:to]
        at = to
        if not wanted.intersection(ids):
            continue
        if len(group) == 1:
            out[ids[0]] = _twisted(low, dia, group[0])[0]
            continue
        spread = group[0] - group[-1]
        if depth >= 12 or spread <= 4 * EPS * abs(group[0]):
            # equal to working precision: other twists, made orthogonal
            basis, used = [], []
            for i, x in zip(ids, group):
                z, r = _twisted(low, dia, x, tuple(used))
                used.append(r)
                for _ in range(2):
                    for b in basis:
                        z = z - (b @ z) * b
                    z = z / max(float(np.linalg.norm(z)), TINY)
                basis.append(z)
                out[i] = z
            continue
        # a new factorisation just outside the cluster, where its members differ in their leading digits
        pad = max(spread * 0.01, 8 * EPS * abs(group[0]))
        options = []
        for shift in (group[0] + pad, group[-1] - pad):
            lo, di, _ = _stationary(low, dia, shift)
            options.append((float(np.max(np.abs(di))), shift, lo, di))
        _, shift, lo, di = min(options, key=lambda o: (not np.isfinite(o[0]), o[0]))
        m = len(dia)
        within = _below(low, dia, group[-1] - pad)  # those under the cluster
        new = []
        for j in range(len(group)):
            rank = within + len(group) - 1 - j
            guess = group[j] - shift
            new.append(_bisected(lo, di, min(rank, m - 1), guess - pad, guess + pad))
        out.update(_vectors(lo, di, new, ids, wanted, depth + 1))
    return out


def top_right_vectors(r: np.ndarray, k: int):
    """(all squared singular values, falling; the right vectors of the first k as rows).

    Vectors of values that are zero to working precision are rows of zeros."""
    d = r.shape[1]
    diagonal, above, right = bidiagonalise(r)
    scale = max([*np.abs(diagonal), *np.abs(above)], default=0.0)
    # where the superdiagonal vanishes, the blocks are solved apart
    bounds = [0, *[i + 1 for i in range(d - 1) if abs(above[i]) <= EPS * scale], d]
    blocks = [(a, b, squared_singular_values(diagonal[a:b], above[a : b - 1])) for a, b in zip(bounds, bounds[1:])]
    every = sorted(((x, n, i) for n, (_, _, xs) in enumerate(blocks) for i, x in enumerate(xs)), key=lambda t: -t[0])
    values = np.array([x for x, _, _ in every])
    picked = [t for t in every[:k] if t[0] > (8 * d * EPS) ** 2 * values[0]] if scale else []
    out = np.zeros((min(k, d), d))
    for n, (a, b, xs) in enumerate(blocks):
        wanted = {i for _, m, i in picked if m == n}
        if not wanted:
            continue
        q = np.where(np.abs(diagonal[a:b]) < EPS * EPS * scale, EPS * EPS * scale, diagonal[a:b])
        got = _vectors(above[a : b - 1] / q[:-1], q * q, xs, list(range(len(xs))), wanted)
        for i in wanted:
            z = np.zeros(d)
            z[a:b] = got[i]
            out[next(j for j, t in enumerate(picked) if t[1:] == (n, i))] = right @ z
    for j in range(len(picked)):  # rounding of the products only: the vectors are orthogonal already
        for i in range(j):
            out[j] -= (out[i] @ out[j]) * out[i]
        out[j] /= np.linalg.norm(out[j])
        out[j] *= math.copysign(1.0, out[j][int(np.argmax(np.abs(out[j])))])
    return values, out
