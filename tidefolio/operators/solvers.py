"""Small dense solvers run inside Spark groups.

All problems of a batch share one covariance matrix and are advanced together: ``w`` has one row per problem and one
column per ticker, and bounds and parameters are columns of shape (problems, 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .covariance import clean_psd

TOL = 1e-12
#: Largest change a full projected step may still make to any weight of a solved problem.
RESIDUAL = 1e-10
#: Newton steps on the shift of a projection, and how near to its goal a row's sum must come.
NEWTON_STEPS, SUM_TOL = 12, 1e-14
#: Steps without a new smallest residual after which a problem counts as not converged.
PATIENCE = 20_000
#: Rounds of an attempt to jump to the optimum, the steps before the first one (as many as tickers in wide markets), most cells of
#: equations solved at a time, and the least share of the largest curvature that the smallest must have.
JUMPS, FIRST_JUMP, JUMP_CELLS, CURVED = 4, 6, 1 << 21, 1e-6

OK, INFEASIBLE, NOT_CONVERGED = "ok", "infeasible", "not_converged"


@dataclass
class Market:
    """One universe: covariance, means, and optional group caps and factor exposures, all in the order of ``names``."""

    names: np.ndarray
    sigma: np.ndarray
    mu: np.ndarray | None = None
    members: np.ndarray | None = None  # (groups, tickers) 0/1
    caps: np.ndarray | None = None
    exposures: np.ndarray | None = None  # (factors, tickers)
    lb: float | None = None
    ub: float | None = None


def _shifted(z: np.ndarray, ref: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """clip(ref + soft(z - theta - ref, t), lo, hi) with theta such that each row sums to ``goal``, exactly.

    Newton's steps on the row sum, which falls with theta in straight pieces, end in the piece that holds the goal; rows
    they leave unsettled, by a step to a place already passed or over a flat piece, are walked through piece by piece.
    """
    w, left = _by_newton(z, ref, t, lo, hi, goal)
    if left.any():
        w[left] = _walked(*(x[left] for x in (z, ref, t, lo, hi, goal)))
    return w


def _by_newton(
    z: np.ndarray, ref: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``_shifted`` and which of them are not settled."""
    n = z.shape[1]
    plain = not t.any()
    theta = (z.sum(axis=1, keepdims=True) - goal) / n
    rows = np.arange(len(z))
    out = np.empty(z.shape)
    left = np.ones(len(z), dtype=bool)
    for _ in range(NEWTON_STEPS):
        if plain:
            v = z - theta
            free = (v > lo) & (v < hi)
        else:
            away = z - theta - ref
            far = np.abs(away) - t
            v = ref + np.sign(away) * np.maximum(far, 0.0)
            free = (v > lo) & (v < hi) & (far > 0.0)
        w = np.minimum(np.maximum(v, lo), hi)
        over = w.sum(axis=1, keepdims=True) - goal
        done = np.abs(over[:, 0]) <= SUM_TOL
        if done.any():
            out[rows[done]], left[rows[done]] = w[done], False
            if done.all():
                break
            go = ~done
            z, ref, t, lo, hi, goal, theta, over, free, rows = (x[go] for x in (z, ref, t, lo, hi, goal, theta, over, free, rows))
        slope = free.sum(axis=1, keepdims=True)
        theta = theta + over / np.maximum(slope, 1)
    return out, left


def _walked(z: np.ndarray, ref: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The rows of ``_shifted``, for any of them.

    Each weight falls with theta from hi to the reference, rests there while theta moves by 2t, and falls on to lo; the
    row sum is walked along the sorted ends of these stretches.
    """
    rest = np.clip(ref, lo, hi)
    falls = np.concatenate([z - t - hi, z + t - rest], axis=1)
    rests = np.concatenate([z - t - rest, z + t - lo], axis=1)
    ends = np.concatenate([falls, rests], axis=1)
    order = np.argsort(ends, axis=1, kind="stable")
    at = np.take_along_axis(ends, order, axis=1)
    slope = np.cumsum(np.where(order < falls.shape[1], -1.0, 1.0), axis=1)
    top = np.broadcast_to(hi, z.shape).sum(axis=1, keepdims=True)
    total = np.concatenate([top, top + np.cumsum(slope[:, :-1] * np.diff(at, axis=1), axis=1)], axis=1)
    last = np.maximum((total >= goal).sum(axis=1) - 1, 0)[:, None]
    run = np.take_along_axis(slope, last, axis=1)
    over = np.take_along_axis(total, last, axis=1) - goal
    theta = np.take_along_axis(at, last, axis=1) + np.divide(over, -run, out=np.zeros_like(over), where=run < 0)
    moved = z - theta - ref
    return np.clip(ref + np.sign(moved) * np.maximum(np.abs(moved) - t, 0.0), lo, hi)


def nearest_rows(
    z: np.ndarray,
    lo: np.ndarray,
    hi: np.ndarray,
    market: Market | None = None,
    ref: np.ndarray | float = 0.0,
    t: np.ndarray | float = 0.0,
) -> np.ndarray:
    """Minimises 1/2 |w - z|^2 + t |w - ref|_1 over row sums of 1, the box, and the market's group caps, exactly.

    Without caps one multiplier settles the row sum. A group whose sum is then beyond its cap is held at the cap, which
    can only raise what the others get, so a held group stays held and each round holds at least one more. A held group
    is settled on its own by a multiplier of its own.
    """
    ref, t = np.broadcast_to(ref, z.shape), np.broadcast_to(t, (len(z), 1))
    lo, hi = np.broadcast_to(lo, z.shape), np.broadcast_to(hi, z.shape)
    one = np.ones((len(z), 1))
    if market is None or market.caps is None:
        return _shifted(z, ref, t, lo, hi, one)
    inside = market.members.astype(bool)
    if inside.sum(axis=0).max(initial=0) > 1:
        raise ValueError("groups must not overlap")
    held = np.zeros((len(z), len(market.caps)), dtype=bool)

    def part(keep: np.ndarray, goal: np.ndarray) -> np.ndarray:
        cut = [np.where(keep, x, 0.0) for x in (z, ref)]
        return _shifted(*cut, t, np.where(keep, lo, 0.0), np.where(keep, hi, 0.0), goal)

    while True:
        taken = held @ inside
        w = part(~taken, one - (held @ market.caps)[:, None])
        over = (w @ inside.T > market.caps + TOL) & ~held
        if not over.any():
            break
        held |= over
    for g, members in enumerate(inside):
        rows = held[:, g]
        if rows.any():
            keep = np.broadcast_to(members, z.shape)
            w = np.where(keep & rows[:, None], part(keep, one * market.caps[g]), w)
    return w


def project_rows(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Nearest point with row sums of 1 inside [lo, hi]."""
    return nearest_rows(v, lo, hi)


def feasible_rows(n: int, lo: np.ndarray, hi: np.ndarray, market: Market | None = None) -> np.ndarray:
    """Whether box, sum and caps of each row can be met together."""
    ok = ((n * lo - 1.0 <= TOL) & (1.0 - n * hi <= TOL) & (lo <= hi)).ravel()
    if market is None or market.caps is None:
        return ok
    size = market.members.sum(axis=1)
    free = n - size.sum()
    most = np.minimum(size * hi, market.caps).sum(axis=1) + free * hi.ravel()
    return ok & (size * lo <= market.caps + TOL).all(axis=1) & (most >= 1.0 - TOL)


def descend(
    market: Market,
    start: np.ndarray,
    anchor: np.ndarray,
    ref: np.ndarray,
    gamma: np.ndarray,
    lam: np.ndarray,
    lo: np.ndarray,
    hi: np.ndarray,
    *,
    l1: bool = False,
    rho: np.ndarray | None = None,
    iters: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Minimises 1/2 (w-a)' S (w-a) - gamma mu'w + penalty(w - ref) [+ rho * exposure penalty]; weights and residuals.

    The penalty is lam/2 |.|^2 or lam |.|_1. Accelerated proximal steps whose momentum a row drops when it points uphill;
    a step is the inverse of the smooth part's Lipschitz constant, exposures included, and ends in the exact nearest
    point under all constraints. A row is done when a plain step moves no weight by more than ``RESIDUAL``; it is given
    up after ``iters`` steps if the caller sets them, or when its residual has not fallen for ``PATIENCE`` steps.

    Smooth, clearly curved problems under box and sum without a limit of steps also try, now and then, to jump: the
    weights off their bounds follow from linear equations while the bounds met and the exposures outside theirs stay the
    same. Only the plain step decides whether a row is done there; the others go on as if nothing had been tried.
    """
    sigma = clean_psd(market.sigma, 1e-10)
    pull = np.zeros_like(start) if market.mu is None else gamma * market.mu
    curvature = np.linalg.eigvalsh(sigma)
    lip = np.full(lo.shape, max(float(curvature[-1]), 1e-8)) + (0.0 if l1 else lam)
    curved = float(curvature[0]) + lam >= CURVED * lip
    x = market.exposures
    bounded = x is not None and rho is not None and np.any(rho > 0) and (market.lb, market.ub) != (None, None)
    if bounded:
        lip = lip + rho * float(np.linalg.eigvalsh(x @ x.T)[-1])

    def step_from(y: np.ndarray, r: np.ndarray) -> np.ndarray:
        grad = (y - anchor[r]) @ sigma - pull[r]
        if not l1:
            grad = grad + lam[r] * (y - ref[r])
        if bounded:
            active = (y - anchor[r]) @ x.T
            high = np.maximum(active - market.ub, 0.0) if market.ub is not None else 0.0
            low = np.maximum(market.lb - active, 0.0) if market.lb is not None else 0.0
            grad = grad + rho[r] * ((high - low) @ x)
        z = y - grad / lip[r]
        shrink = lam[r] / lip[r] if l1 else 0.0
        return nearest_rows(z, lo[r], hi[r], market, ref[r], shrink)

    def jump(at: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Where the gradients of the weights that ``at`` has off their bounds are equal, the others and the sum of 1 kept."""
        n = at.shape[1]
        free = (at > lo[r]) & (at < hi[r])
        push, curve = anchor[r] @ sigma + pull[r] + lam[r] * ref[r], np.broadcast_to(sigma, (len(r), n, n))
        curve = curve + lam[r, :, None] * np.eye(n)
        if bounded:
            active, own = (at - anchor[r]) @ x.T, anchor[r] @ x.T
            high = active > market.ub if market.ub is not None else np.zeros(active.shape, dtype=bool)
            low = active < market.lb if market.lb is not None else np.zeros(active.shape, dtype=bool)
            edge = np.where(high, market.ub or 0.0, 0.0) + np.where(low, market.lb or 0.0, 0.0)
            out = rho[r] * (high | low)
            push = push + (out * (own + edge)) @ x
            curve = curve + (x.T * out[:, None, :]) @ x
        left = np.zeros((len(r), n + 1, n + 1))
        left[:, :n, :n] = np.where(free[:, :, None], curve, np.eye(n))
        left[:, :n, n], left[:, n, :n] = free, 1.0
        right = np.concatenate([np.where(free, push, at), np.ones((len(r), 1))], axis=1)
        return np.linalg.solve(left, right[:, :, None])[:, :n, 0]

    def jumped(at: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points that a few jumps lead to, each followed by a plain step, and the change that a further one makes."""
        found, change = at.copy(), np.full(len(r), np.inf)
        todo = np.flatnonzero(curved[r, 0])
        for _ in range(JUMPS):
            # Without a weight off its bounds there is nothing to solve.
            todo = todo[((found[todo] > lo[r[todo]]) & (found[todo] < hi[r[todo]])).any(axis=1)]
            if not len(todo):
                break
            some = max(1, JUMP_CELLS // (at.shape[1] + 1) ** 2)
            try:
                to = np.concatenate([jump(found[k], r[k]) for k in (todo[i : i + some] for i in range(0, len(todo), some))])
            except np.linalg.LinAlgError:
                break
            to = np.clip(to, lo[r[todo]], hi[r[todo]])
            found[todo] = step_from(to, r[todo])
            near = todo[np.abs(found[todo] - to).max(axis=1) <= RESIDUAL]
            if len(near):
                change[near] = np.abs(step_from(found[near], r[near]) - found[near]).max(axis=1)
            todo = todo[change[todo] > RESIDUAL]
        return found, change

    n = start.shape[1]
    jumping = not l1 and market.caps is None and iters is None and (n + 1) ** 2 <= JUMP_CELLS
    next_jump = FIRST_JUMP if n <= 64 else n
    w = nearest_rows(start, lo, hi, market)
    residual = np.full(len(w), np.inf)
    rows = np.arange(len(w))
    now, y, speed = w.copy(), w.copy(), np.ones((len(w), 1))
    best, since, steps = np.full(len(w), np.inf), np.zeros(len(w), dtype=int), 0
    while len(rows) and (iters is None or steps < iters):
        steps += 1
        new = step_from(y, rows)
        uphill = ((y - new) * (new - now)).sum(axis=1, keepdims=True) > 0
        faster = (1.0 + np.sqrt(1.0 + 4.0 * speed * speed)) / 2.0
        ahead = new + np.where(uphill, 0.0, (speed - 1.0) / faster) * (new - now)
        moved = np.abs(y - new).max(axis=1)
        settled = moved <= RESIDUAL
        if settled.any():  # a step from the point itself, without momentum, decides
            moved[settled] = np.abs(step_from(new[settled], rows[settled]) - new[settled]).max(axis=1)
        since = np.where(moved < best[rows], 0, since + 1)
        best[rows] = np.minimum(best[rows], moved)
        w[rows], residual[rows] = new, moved
        if jumping and steps == next_jump:
            next_jump *= 2
            trying = np.flatnonzero(moved > RESIDUAL)
            to, change = jumped(new[trying], rows[trying])
            there = change <= RESIDUAL
            moved[trying[there]] = change[there]
            w[rows[trying[there]]], residual[rows[trying[there]]] = to[there], change[there]
        go = ((moved > RESIDUAL) & (since < PATIENCE)).nonzero()[0]
        now, y, since = new[go], ahead[go], since[go]
        speed = np.where(uphill, 1.0, faster)[go]
        rows = rows[go]
    if len(rows):
        residual[rows] = np.abs(step_from(w[rows], rows) - w[rows]).max(axis=1)
    return w, residual


def balanced(sigma: np.ndarray, limit: int = 200) -> tuple[np.ndarray, int]:
    """Weights of equal risk contributions without a box, summing to 1, and the number of factorizations.

    The minimum of 1/2 y'Cy - sum(log y) over the correlations C, by Newton steps that stay positive and go down; only the
    scale of the answer depends on the budget, so it is set at the end.
    """
    sd = np.sqrt(np.diag(sigma))
    c = sigma / sd[:, None] / sd[None, :]
    y = np.full(len(c), np.sqrt(len(c) / max(c.sum(), 1e-12)))
    value = lambda v: 0.5 * v @ c @ v - np.log(v).sum()
    last = np.inf
    for used in range(1, limit + 1):
        slope = c @ y - 1.0 / y
        step = np.linalg.solve(c + np.diag(1.0 / (y * y)), slope)
        decrement = float(slope @ step)
        fall = np.max(step / y)
        t = 1.0 if fall < 0.95 else 0.95 / fall
        now = value(y)
        while decrement > 1e-12 and value(y - t * step) > now - 1e-4 * t * decrement and t > 1e-12:
            t /= 2
        y = y - t * step
        if decrement <= 1e-24 or (decrement <= 1e-20 and decrement >= last):
            break
        last = decrement
    w = y / sd
    return w / w.sum(), used


def _share_gap(sigma: np.ndarray, w: np.ndarray, c: float, lo: np.ndarray, hi: np.ndarray) -> float:
    """Largest relative gap of the contributions from c, where no bound allows one, or the sum's distance from 1."""
    gap = w * (sigma @ w) / c - 1.0
    # Too large a share is right at lo only, too small a one at hi only.
    wrong = np.where(w <= lo, np.maximum(-gap, 0.0), np.where(w >= hi, np.maximum(gap, 0.0), np.abs(gap)))
    return max(float(wrong.max()), abs(float(w.sum()) - 1.0))


def _newton_in_box(
    sigma: np.ndarray, w: np.ndarray, c: float, lo: np.ndarray, hi: np.ndarray, limit: int, budget: bool
) -> tuple[np.ndarray, float]:
    """Newton steps on the weights off their bounds, and on c too where the sum is to be 1; one factorization a step."""
    best, best_gap = (w, c), np.inf
    value = lambda v: 0.5 * v @ sigma @ v - c * np.log(v).sum()
    for _ in range(limit):
        slope = sigma @ w - c / w
        free = ~(((w <= lo) & (slope > 0)) | ((w >= hi) & (slope < 0)))
        gap = _share_gap(sigma, w, c, lo, hi) if budget else float(np.abs(np.where(free, slope * w / c, 0.0)).max())
        if gap < best_gap:
            best, best_gap = (w, c), gap
        if gap <= 1e-13 or not free.any():
            break
        v = w[free]
        to = np.linalg.solve(sigma[np.ix_(free, free)] + np.diag(c / (v * v)), np.stack([-slope[free], 1.0 / v], axis=1))
        rise = float(to[:, 1].sum())
        dc = (1.0 - w.sum() - to[:, 0].sum()) / rise if budget and rise > 0 else 0.0
        dw = to[:, 0] + dc * to[:, 1]
        t = min(1.0, 0.9 / max(np.max(-dw / v), -dc / c, 1e-300))
        moved = w.copy()
        moved[free] = np.clip(v + t * dw, lo[free], hi[free])
        while not budget and t > 1e-12 and value(moved) > value(w) + 1e-4 * slope[free] @ (moved[free] - v):
            t /= 2
            moved[free] = np.clip(v + t * dw, lo[free], hi[free])
        w, c = moved, c + t * dc
    return best


def boxed_risk(sigma: np.ndarray, lo: np.ndarray, hi: np.ndarray, iters: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Risk parity in a box: the minimum of 1/2 w'Sw - c sum(log w) in [lo, hi] with c such that w sums to 1.

    Weights inside the box contribute equally (c each), those at lo no less and those at hi no more. Newton steps move the
    weights off their bounds together with c. Where they do not settle, c is bisected (the sum rises with it) around the
    same steps for a fixed c, a convex problem. The residual is the largest relative gap of these conditions, or the
    sum's distance from 1.
    """
    rows, n = len(lo), len(sigma)
    limit = 100 if iters is None else iters
    start, _ = balanced(sigma, max(limit, 1))
    out, residual = np.empty((rows, n)), np.empty(rows)
    for k in range(rows):
        low, high = np.full(n, max(float(lo[k, 0]), 0.0)), np.full(n, float(hi[k, 0]))
        w = project_rows(start[None, :], low[None, :], high[None, :])[0]
        w = np.maximum(w, 1e-12)
        c = float(w @ sigma @ w) / n
        w, c = _newton_in_box(sigma, w, c, low, high, limit, True)
        gap = _share_gap(sigma, w, c, low, high)
        if gap > 1e-9 and iters is None:
            ends = [c * 1e-6, c * 1e6]
            for _ in range(100):
                c = float(np.sqrt(ends[0] * ends[1]))
                w, _ = _newton_in_box(sigma, w, c, low, high, 200, False)
                ends[1 if w.sum() > 1.0 else 0] = c
                if ends[1] - ends[0] <= 1e-15 * ends[1]:
                    break
            gap = _share_gap(sigma, w, c, low, high)
        out[k], residual[k] = w, gap
    return out, residual


def risk_parity(market: Market, lo: np.ndarray, hi: np.ndarray, iters: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and residuals; all rows share the unbounded answer where their box admits it."""
    sigma = clean_psd(market.sigma, 1e-10)
    wide = np.ones((1, 1))
    free, gap = boxed_risk(sigma, 0 * wide, wide, iters)
    inside = ((free >= lo) & (free <= hi)).all(axis=1)
    w, residual = np.repeat(free, len(lo), axis=0), np.repeat(gap, len(lo))
    if not inside.all():
        w[~inside], residual[~inside] = boxed_risk(sigma, lo[~inside], hi[~inside], iters)
    return w, residual


# --- tail risk ----------------------------------------------------------------------------------------------------

GAP = 1e-9  # relative gap between the objective and its dual bound


def linear_program(c: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """min c'x with a x = b, x >= 0, by a predictor-corrector interior point; the point, its multipliers and relative gap.

    Each step solves the normal equations twice: once straight for the optimum, which tells how much centring is needed,
    and once with that centring and the second-order term of the first.
    """
    n = len(c)
    norm = 1.0 + max(np.abs(b).max(initial=0.0), np.abs(c).max(initial=0.0))
    x, y, s = np.ones(n), np.zeros(len(b)), np.ones(n)
    best, best_y, best_gap = x, y, np.inf
    for _ in range(limit):
        primal, dual = b - a @ x, c - a.T @ y - s
        gap = max(abs(c @ x - b @ y) / (1.0 + abs(c @ x)), np.abs(primal).max() / norm, np.abs(dual).max() / norm)
        if gap < best_gap:
            best, best_y, best_gap = x, y, gap
        if gap <= GAP / 10:
            break
        scale = x / s
        normal = (a * scale) @ a.T
        normal[np.diag_indices_from(normal)] += 1e-14 * max(1.0, np.trace(normal) / len(normal))

        def direction(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dy = np.linalg.solve(normal, primal + a @ (scale * dual - target / s))
            ds = dual - a.T @ dy
            return (target - x * ds) / s, dy, ds

        def longest(v: np.ndarray, dv: np.ndarray) -> float:
            return min(1.0, float(np.min(np.where(dv < 0, -v / np.where(dv < 0, dv, -1.0), np.inf))))

        mean = x @ s / n
        try:
            dx, _, ds = direction(-x * s)
            after = (x + longest(x, dx) * dx) @ (s + longest(s, ds) * ds) / n
            dx, dy, ds = direction((after / mean) ** 3 * mean - x * s - dx * ds)
        except np.linalg.LinAlgError:
            break
        if not np.isfinite(dx).all():
            break
        x = x + 0.995 * longest(x, dx) * dx
        step = 0.995 * longest(s, ds)
        y, s = y + step * dy, s + step * ds
    return best, best_y, best_gap


def least_cvar(
    scenarios: np.ndarray, alpha: float, lam: float, ref: np.ndarray, lo: float, hi: float, limit: int = 200
) -> tuple[np.ndarray, float]:
    """Weights in [lo, hi] summing to 1 with the least CVaR of the loss plus lam |w - ref|_1, and the relative gap.

    CVaR is the least over v of v + mean excess of the loss over v / (1 - alpha). Unknowns, all at least 0: w - lo, hi - w,
    excesses, shortfalls, v above the least loss there can be, and purchases and sales where they cost.
    """
    t, n = scenarios.shape
    pay = lam > 0
    one, zero = np.eye(n), np.zeros
    size = 1.0 if lo >= 0 else n * max(abs(lo), abs(hi))
    floor = -float(scenarios.max(initial=0.0) if lo >= 0 else np.abs(scenarios).max(initial=0.0)) * size
    blocks = [
        np.hstack([one, one, zero((n, 2 * t + 1 + 2 * n * pay))]),
        np.hstack([-scenarios, zero((t, n)), -np.eye(t), np.eye(t), -np.ones((t, 1)), zero((t, 2 * n * pay))]),
        np.hstack([np.ones((1, n)), zero((1, n + 2 * t + 1 + 2 * n * pay))]),
    ]
    right = [np.full(n, hi - lo), scenarios.sum(axis=1) * lo + floor, [1.0 - n * lo]]
    if pay:
        blocks.append(np.hstack([one, zero((n, n + 2 * t + 1)), -one, one]))
        right.append(ref - lo)
    tail = np.full(t, 1.0 / ((1.0 - alpha) * t))
    cost = np.concatenate([zero(2 * n), tail, zero(t), [1.0], np.full(2 * n * pay, lam)])
    x, _, gap = linear_program(cost, np.vstack(blocks), np.concatenate(right), limit)
    w = x[:n] + lo
    return project_rows(w[None, :], np.array([[lo]]), np.array([[hi]]))[0], gap


def tail_master(
    cuts: np.ndarray, blocks: int, lam: float, ref: np.ndarray, lo: float, hi: float, floor: float
) -> tuple[np.ndarray, float, float]:
    """Weights, loss level v and value of the least v + sum of block excesses + lam |w - ref|_1 that the cuts allow.

    A cut (block, n, g) says that the block's excess is at least g'w - n v. The last weight is one minus the others, so all
    constraints are inequalities on free unknowns (weights, v, an excess per block, a distance per weight where it costs).
    What is solved is the dual: as many equations as unknowns, and one variable at least 0 per cut or bound.
    """
    n, pay = cuts.shape[1] - 2, lam > 0
    size = n - 1 + 1 + blocks + n * pay
    level, excess, away = n - 1, n, n + blocks

    def on_weights(rows: np.ndarray) -> np.ndarray:
        return rows[:, :-1] - rows[:, -1:]

    one = np.eye(n)
    k = len(cuts)
    lines = np.zeros((k, size))
    lines[:, : n - 1], lines[:, level] = -on_weights(cuts[:, 2:]), cuts[:, 1]
    lines[np.arange(k), excess + cuts[:, 0].astype(int)] = 1.0
    spare = np.zeros((blocks + 1, size))
    spare[np.arange(blocks), excess + np.arange(blocks)] = 1.0
    spare[blocks, level] = 1.0
    boxed = np.zeros((2 * n, size))
    boxed[:n, : n - 1], boxed[n:, : n - 1] = on_weights(one), -on_weights(one)
    last = one[-1]
    parts, right = [lines, spare, boxed], [cuts[:, -1], np.zeros(blocks), [floor], lo - last, last - hi]
    goal = np.zeros(size)
    goal[level : excess + blocks] = 1.0
    if pay:
        moved = np.zeros((2 * n, size))
        moved[:n, : n - 1], moved[n:, : n - 1] = -on_weights(one), on_weights(one)
        moved[:n, away:] = moved[n:, away:] = one
        parts.append(moved)
        right += [last - ref, ref - last]
        goal[away:] = lam
    rows, bounds = np.vstack(parts), np.concatenate(right)
    y, u, _ = linear_program(-bounds, rows.T, goal)
    x = -u[: n - 1]
    return np.append(x, 1.0 - x.sum()), float(-u[level]), float(bounds @ y)


def tail_cuts(scenarios: np.ndarray, w: np.ndarray, v: float, share: float) -> np.ndarray:
    """(value, n, g): the scenarios' excess of the loss over v, times ``share``, and its slopes in v and w."""
    loss = -scenarios @ w
    beyond = loss > v
    return np.concatenate(([share * (loss[beyond] - v).sum(), share * beyond.sum()], -share * scenarios[beyond].sum(axis=0)))


# --- hierarchical risk parity -------------------------------------------------------------------------------------

#: Cells of a temporary array of ``least_sums``: small enough to stay near the core.
NEAR = 1 << 16


def least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min over k of a[i, k] + b[k, j]."""
    across = np.ascontiguousarray(b.T)
    best = np.empty((len(a), len(across)))
    step = max(1, NEAR // max(1, a.shape[1]))
    for j in range(0, len(across), step):
        part = across[j : j + step]
        sums = np.empty_like(part)
        for i, row in enumerate(a):
            np.add(part, row, out=sums)
            sums.min(axis=1, out=best[i, j : j + step])
    return best


def spanning_links(distance: np.ndarray) -> list[tuple[float, int, int]]:
    """(distance, i, j) of a least spanning tree, grown from the first item."""
    n = len(distance)
    near, by = distance[0].astype(float), np.zeros(n, dtype=int)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    links = []
    for _ in range(n - 1):
        new = int(np.where(outside, near, np.inf).argmin())
        links.append((float(near[new]), int(by[new]), new))
        outside[new] = False
        closer = outside & (distance[new] < near)
        near[closer], by[closer] = distance[new][closer], new
    return links


def chain_links(distance: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """(height, i, j) of the merges by a chain of nearest neighbours: clusters that are each other's nearest are merged,
    whichever comes first, as complete, average and ward linkage never bring a merged cluster nearer to a third."""
    n = len(distance)
    d = distance.astype(float) ** 2 if linkage == "ward" else distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    links, chain, start = [], [], 0
    while len(links) < n - 1:
        if not chain:
            while not alive[start]:
                start += 1
            chain.append(start)
        tip = chain[-1]
        to = int(d[tip].argmin())
        if len(chain) < 2 or d[tip, to] < d[tip, chain[-2]]:
            chain.append(to)
            continue
        a, b = chain.pop(), chain.pop()
        between = d[a, b]
        if linkage == "complete":
            row = np.maximum(d[a], d[b])
        elif linkage == "average":
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            row = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * between) / (size[a] + size[b] + size)
        size[a] += size[b]
        alive[b] = False
        row[~alive], row[a] = np.inf, np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        links.append((float(np.sqrt(max(between, 0.0))) if linkage == "ward" else float(between), a, b))
    return links


class _Ends:
    """A cluster: its leaves and, for an end in the left half and one in the right, the least sum of neighbour distances."""

    def __init__(self, leaves: list[int], halves: tuple[_Ends, _Ends] | None = None, across: np.ndarray | None = None):
        self.leaves, self.halves, self.across = leaves, halves, across

    @classmethod
    def joined(cls, left: _Ends, right: _Ends, distance: np.ndarray, ordered: bool) -> _Ends:
        leaves = left.leaves + right.leaves
        if not ordered:
            return cls(leaves)
        reach = left.inward(distance[np.ix_(left.leaves, right.leaves)])
        return cls(leaves, (left, right), right.inward(reach.T).T)

    def inward(self, beyond: np.ndarray) -> np.ndarray:
        """For each end leaf: the least way through this cluster to some other end and on, by ``beyond``, to each column."""
        if self.halves is None:
            return beyond
        n = len(self.halves[0].leaves)
        return np.vstack([least_sums(self.across, beyond[n:]), least_sums(self.across.T, beyond[:n])])

    def ways(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the leaves that can be the other end, and the sum to each."""
        if self.halves is None:
            return np.zeros(1, dtype=int), np.zeros(1)
        n = len(self.halves[0].leaves)
        return (np.arange(n, len(self.leaves)), self.across[end]) if end < n else (np.arange(n), self.across[:, end - n])

    def order(self, distance: np.ndarray) -> list[int]:
        """Leaves in the order of the least sum."""
        if self.halves is None:
            return list(self.leaves)
        start, end = divmod(int(self.across.argmin()), self.across.shape[1])
        out: list[int] = []
        todo = [(self, start, end + len(self.across), False)]  # cluster, its first and last leaf, whether to be read backwards
        while todo:
            node, i, j, back = todo.pop()
            if node.halves is None:
                out.append(node.leaves[0])
                continue
            left, right = node.halves
            n = len(left.leaves)
            if i >= n:
                i, j, back = j, i, not back
            inner, so_far = left.ways(i)
            first, to_end = right.ways(j - n)
            between = distance[np.ix_([left.leaves[k] for k in inner], [right.leaves[k] for k in first])]
            k, m = divmod(int((so_far[:, None] + between + to_end).argmin()), len(first))
            parts = [(left, i, int(inner[k]), back), (right, int(first[m]), j - n, back)]
            todo += parts if back else parts[::-1]
        return out


def cluster_order(distance: np.ndarray, linkage: str, ordered: bool = True) -> list[int]:
    """Leaf order of agglomerative clustering (single, complete, average, ward), the older cluster to the left.

    Merges are found in a time of the square of the names and then taken by height. ``ordered`` turns the clusters so that
    the distances between neighbouring leaves have the least sum.
    """
    if linkage not in ("single", "complete", "average", "ward"):
        raise ValueError("linkage must be 'single', 'complete', 'average' or 'ward'")
    n = len(distance)
    links = spanning_links(distance) if linkage == "single" else chain_links(distance, linkage)
    above, label = list(range(n)), list(range(n))
    clusters = {k: _Ends([k]) for k in range(n)}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for merge, (_, i, j) in enumerate(sorted(links, key=lambda x: x[0])):
        a, b = root(i), root(j)
        if label[a] > label[b]:
            a, b = b, a
        clusters[a] = _Ends.joined(clusters[a], clusters.pop(b), distance, ordered)
        above[b], label[a] = a, n + merge
    (top,) = clusters.values()
    return top.order(distance) if ordered else list(top.leaves)


def hrp(sigma: np.ndarray, linkage: str = "ward", ordered: bool = True) -> np.ndarray:
    """Recursive bisection of the clustered order, each half weighted by the other half's inverse-variance risk."""
    s = clean_psd(sigma, 1e-10)
    sd = np.sqrt(np.maximum(np.diag(s), 1e-16))
    rho = np.clip(s / sd[:, None] / sd[None, :], -1.0, 1.0)
    order = cluster_order(np.sqrt(np.maximum((1.0 - rho) / 2.0, 0.0)), linkage, ordered)

    def risk(items: list[int]) -> float:
        inverse = 1.0 / np.diag(s)[items]
        share = inverse / inverse.sum()
        return float(share @ s[np.ix_(items, items)] @ share)

    w = np.ones(len(s))
    todo = [order]
    while todo:
        items = todo.pop()
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            vl, vr = risk(left), risk(right)
            w[left] *= vr / (vl + vr)
            w[right] *= vl / (vl + vr)
            todo += [left, right]
    return w


def inverse_products(sigma: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S^-1 1 and S^-1 mu with a pseudo-inverse: all the closed forms need."""
    inverse = np.linalg.pinv(clean_psd(sigma, 1e-10))
    return inverse @ np.ones(len(mu)), inverse @ mu


def optimise(
    market: Market,
    method: str,
    *,
    gamma: np.ndarray,
    lam: np.ndarray,
    lo: np.ndarray,
    hi: np.ndarray,
    bench: np.ndarray,
    ref: np.ndarray,
    rho: np.ndarray,
    iters: int | None = None,
    linkage: str = "ward",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, status and residual of every problem of the batch: 'ok' where the residual is within tolerance,
    'infeasible' where box and caps cannot be met (equal weights, no residual), 'not_converged' elsewhere."""
    rows, n = bench.shape
    ok = feasible_rows(n, lo, hi, market)
    equal, zero = np.full((rows, n), 1.0 / n), np.zeros((rows, n))
    w, residual = equal.copy(), np.full(rows, np.nan)
    some = np.flatnonzero(ok)
    if len(some):
        lo, hi, gamma, lam, rho = (x[some] for x in (lo, hi, gamma, lam, rho))
        bench, ref, equal, zero = (x[some] for x in (bench, ref, equal, zero))
        common = dict(lo=lo, hi=hi, iters=iters)
        if method in ("mv_l2", "mv_l1"):
            found = descend(market, equal, zero, ref, gamma, lam, l1=method == "mv_l1", **common)
        elif method == "min_te":
            found = descend(market, equal, bench, bench, 0 * gamma, 0 * lam, **common)
        elif method == "mean_te":
            found = descend(market, bench, bench, bench, gamma, 0 * lam, **common)
        elif method == "te_active":
            found = descend(market, bench, bench, ref, gamma, lam, rho=rho, **common)
        elif method == "risk_parity":
            found = risk_parity(market, lo, hi, iters=iters)
        elif method == "hrp":
            found = project_rows(np.tile(hrp(market.sigma, linkage), (len(some), 1)), lo, hi), np.zeros(len(some))
        elif method == "group_caps":
            found = nearest_rows(ref, lo, hi, market), np.zeros(len(some))
        else:
            raise ValueError(f"unknown method {method!r}")
        w[some], residual[some] = found
    within = residual <= (1e-6 if method == "risk_parity" else RESIDUAL)
    return w, np.where(ok, np.where(within, OK, NOT_CONVERGED), INFEASIBLE), residual
