"""Nelder-Mead with a coordinate polish."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(fn: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, rounds: int = 4000, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    n = len(start)
    pts = [np.asarray(start, dtype=float)] + [np.asarray(start, dtype=float) + step * np.eye(n)[k] for k in range(n)]
    vals = [fn(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = [pts[k] for k in order], [vals[k] for k in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + 1e-10):
            break
        mid = np.mean(pts[:-1], axis=0)
        ref = mid + (mid - pts[-1])
        fr = fn(ref)
        if fr < vals[0]:
            far = mid + 2 * (mid - pts[-1])
            fe = fn(far)
            pts[-1], vals[-1] = (far, fe) if fe < fr else (ref, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = ref, fr
        else:
            near = mid + 0.5 * ((ref if fr < vals[-1] else pts[-1]) - mid)
            fc = fn(near)
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = near, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [fn(p) for p in pts[1:]]
    best, value = pts[0], vals[0]
    width = 1e-3
    while width > 1e-9:
        moved = False
        for k in range(n):
            for sign in (1, -1):
                trial = best.copy()
                trial[k] += sign * width
                v = fn(trial)
                if v < value:
                    best, value, moved = trial, v, True
        width = width if moved else width / 4
    return best, value
