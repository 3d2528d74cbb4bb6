"""Krylov methods on three-term processes: Lanczos, two-sided Lanczos, orthogonal tridiagonalisation.

A process yields basis vectors and the columns of a tridiagonal matrix T; a fold turns them into a
solution while keeping a few vectors. :class:`LeastResidual` takes T's QR factor and lowers the residual;
:class:`LeastError` takes its LQ factor, and has the Galerkin point beside the point of least error.
Complex systems are solved as real ones of twice the size.
"""

from __future__ import annotations

import numpy as np

from ..plans.problem import RetCode

TINY = 1e-14


def _same(x):
    return x


class LeastResidual:
    """x with the least residual of T y = beta e1, from T's columns (above, diagonal, below)."""

    def __init__(self, beta: float, like: np.ndarray):
        self.x = np.zeros_like(like)
        self.w1 = self.w2 = np.zeros_like(like)
        self.c1, self.s1, self.c2, self.s2 = 1.0, 0.0, 1.0, 0.0
        self.left = beta

    def add(self, v: np.ndarray, above: float, diagonal: float, below: float) -> bool:
        far, near = self.s2 * above, self.c2 * above
        middle, own = self.c1 * near + self.s1 * diagonal, self.c1 * diagonal - self.s1 * near
        size = float(np.hypot(own, below))
        if size == 0:
            return False
        w = (v - middle * self.w1 - far * self.w2) / size
        self.c2, self.s2, self.c1, self.s1 = self.c1, self.s1, own / size, below / size
        self.x = self.x + self.c1 * self.left * w
        self.left = -self.s1 * self.left
        self.w2, self.w1 = self.w1, w
        return True


class LeastError:
    """Both points of T y = beta e1 from T's rows: ``x`` has the least error in its space, ``galerkin()`` the zero residual in T."""

    def __init__(self, beta: float, v: np.ndarray, diagonal: float):
        self.x = np.zeros_like(v)
        self.bar, self.d, self.pending = float(diagonal), v, float(beta)
        self.c = self.s = None
        self.z = 0.0

    def galerkin(self) -> np.ndarray | None:
        return self.x + self.pending / self.bar * self.d if abs(self.bar) > TINY else None

    def last(self) -> float:
        """The last component of the Galerkin point in the basis."""
        own = self.pending / self.bar if abs(self.bar) > TINY else np.inf
        return own if self.s is None else self.s * self.z - self.c * own

    def add(self, v: np.ndarray, above: float, below: float, diagonal: float) -> bool:
        """The next basis vector, the entry beside the diagonal of the row before, and the new row's two entries."""
        size = float(np.hypot(self.bar, above))
        if size == 0:
            return False
        c, s = self.bar / size, above / size
        z = self.pending / size
        self.x = self.x + z * (c * self.d + s * v)
        self.d = s * self.d - c * v
        under = below if self.c is None else -self.c * below
        second = 0.0 if self.s is None else self.s * below
        self.pending = -(second * self.z) - (c * under + s * diagonal) * z
        self.bar = s * under - c * diagonal
        self.c, self.s, self.z = c, s, z
        return True


def lanczos(A, r, Pl=_same):
    """(vector for x, above, diagonal, below, next vector for x) of a symmetric matrix, with a positive preconditioner."""
    z = Pl(r)
    size = float(np.sqrt(max(0.0, r @ z)))
    if size == 0:
        return
    old, v, z, above = np.zeros_like(r), r / size, z / size, 0.0
    while True:
        q = A(z) - above * old
        diagonal = float(z @ q)
        q = q - diagonal * v
        next_z = Pl(q)
        below = float(np.sqrt(max(0.0, q @ next_z)))
        done = below <= TINY * max(1.0, abs(diagonal))
        yield z, above, diagonal, 0.0 if done else below, None if done else next_z / below
        if done:
            return
        old, v, z, above = v, q / below, next_z / below, below


def two_sided(A, At, r, c=None):
    """As :func:`lanczos` for any square matrix, with the adjoint's vector as the last item; it may break down."""
    start = r if c is None else c
    size = float(np.linalg.norm(r))
    inner = float(start @ r)
    if size == 0 or inner == 0:
        return
    v, w = r / size, start * (size / inner)
    old_v, old_w, below, above = np.zeros_like(r), np.zeros_like(r), 0.0, 0.0
    while True:
        q, p = A(v) - above * old_v, At(w) - below * old_w
        diagonal = float(w @ q)
        q, p = q - diagonal * v, p - diagonal * w
        inner = float(p @ q)
        new_below = float(np.linalg.norm(q))
        done = abs(inner) <= TINY**2 * max(1e-300, np.linalg.norm(p) * new_below) or new_below <= TINY * max(1.0, abs(diagonal))
        if done:
            yield v, above, diagonal, 0.0, None, w, 0.0
            return
        new_above = inner / new_below
        yield v, above, diagonal, new_below, q / new_below, w, new_above
        old_v, old_w, v, w, below, above = v, w, q / new_below, p / new_above, new_below, new_above


def orthogonal(A, At, r, c, kept: tuple[list, list] | None = None):
    """(u, v, above, diagonal, below, next above, next u, next v): A u's in the basis of v's, and its adjoint the other way.

    With ``kept``, lists that take the vectors, each new one is made orthogonal to all of them once more.
    """
    beta, gamma = float(np.linalg.norm(r)), float(np.linalg.norm(c))
    if beta == 0 or gamma == 0:
        return
    v, u, old_v, old_u, below, above = r / beta, c / gamma, np.zeros_like(r), np.zeros_like(c), 0.0, 0.0
    while True:
        q, p = A(u) - above * old_v, At(v) - below * old_u
        diagonal = float(v @ q)
        q, p = q - diagonal * v, p - diagonal * u
        if kept is not None:
            kept[0].append(u)
            kept[1].append(v)
            for _ in range(2):
                p = p - np.array(kept[0]).T @ (np.array(kept[0]) @ p)
                q = q - np.array(kept[1]).T @ (np.array(kept[1]) @ q)
        new_below, new_above = float(np.linalg.norm(q)), float(np.linalg.norm(p))
        end = TINY * max(1.0, abs(diagonal), below, above)
        next_v, next_u = (q / new_below if new_below > end else None), (p / new_above if new_above > end else None)
        yield u, v, above, diagonal, new_below if next_v is not None else 0.0, new_above if next_u is not None else 0.0, next_u, next_v
        if next_u is None or next_v is None:
            return
        old_v, old_u, v, u, below, above = v, u, next_v, next_u, new_below, new_above


def real(method):
    """The method for complex systems too: real and imaginary parts one after the other."""

    def run(A, b, *, At=None, Pl=_same, Pr=_same, x0=None, **kw):
        if not np.iscomplexobj(b):
            try:
                probe = A(np.zeros(kw.get("n", len(b))))
            except TypeError:
                probe = b
            if not np.iscomplexobj(probe):
                return method(A, b, At=At, Pl=Pl, Pr=Pr, x0=x0, **kw)
        join = lambda x: np.concatenate([np.real(x), np.imag(x)])
        split = lambda x: x[: len(x) // 2] + 1j * x[len(x) // 2 :]
        wrap = lambda f: None if f is None else (lambda x: join(f(split(x))))
        same = lambda f: f if f is _same else wrap(f)
        x, *rest = method(wrap(A), join(b), At=wrap(At), Pl=same(Pl), Pr=same(Pr), x0=None if x0 is None else join(x0), **{**kw, "n": 2 * kw.get("n", len(b)), "maxiters": 2 * kw["maxiters"]})
        return split(x), *rest

    return run


def _start(A, b, x0, n=None):
    x = np.zeros(len(b) if n is None else n) if x0 is None else np.array(x0, float)
    return x, b - A(x) if x0 is not None else np.array(b, float)


def _done(A, b, x, limit, k, maxiters):
    r = float(np.linalg.norm(b - A(x)))
    code = RetCode.SUCCESS if r <= limit * (1 + 1e-6) else RetCode.MAXITERS if k >= maxiters else RetCode.CONVERGENCE_FAILURE
    return x, code if np.isfinite(r) else RetCode.FAILURE, k, r


@real
def minres(A, b, *, Pl=_same, x0=None, limit, maxiters, **_):
    """Least residuals of a symmetric matrix, definite or not; with ``Pl`` in its norm, so the true residual decides at the end."""
    x, r = _start(A, b, x0)
    k = 0
    while np.linalg.norm(r) > limit and k < maxiters:  # a second round only where the preconditioner's norm was met first
        fold = LeastResidual(float(np.sqrt(max(0.0, r @ Pl(r)))), r)
        goal, before, at = limit * fold.left / np.linalg.norm(r), np.linalg.norm(r), k
        for z, above, diagonal, below, _next in lanczos(A, r, Pl):
            k += 1
            if not fold.add(z, above, diagonal, below) or abs(fold.left) <= goal or k >= maxiters:
                break
        x = x + fold.x
        r = b - A(x)
        if k == at or np.linalg.norm(r) > 0.99 * before:
            break
    return _done(A, b, x, limit, k, maxiters)


@real
def symmlq(A, b, *, Pl=_same, x0=None, limit, maxiters, **_):
    """Least error over A times the Krylov space; the Galerkin point is returned where it is closer."""
    x, r = _start(A, b, x0)
    k = 0
    while np.linalg.norm(r) > limit and k < maxiters:
        before, fold, at = np.linalg.norm(r), None, k
        beta = float(np.sqrt(max(0.0, r @ Pl(r))))
        goal = limit * beta / before
        for z, above, diagonal, below, _next in lanczos(A, r, Pl):
            if fold is None:
                fold = LeastError(beta, z, diagonal)
            elif not fold.add(z, above, above, diagonal):
                break
            k += 1
            if below * abs(fold.last()) <= goal or k >= maxiters:
                break
        if fold is None:
            break
        new = min((x + p for p in (fold.galerkin(), fold.x) if p is not None), key=lambda p: np.linalg.norm(b - A(p)))
        r = b - A(new)
        if np.linalg.norm(r) < before:
            x = new
        if k == at or not np.linalg.norm(r) < 0.99 * before:
            break
    return _done(A, b, x, limit, k, maxiters)


@real
def cg_lanczos(A, b, *, Pl=_same, x0=None, limit, maxiters, **_):
    """Conjugate gradients from the L D L' factor of the Lanczos matrix; for positive definite matrices."""
    x, r = _start(A, b, x0)
    w, k = float(np.sqrt(max(0.0, r @ Pl(r)))), 0
    goal, d, p = limit * w / max(1e-300, np.linalg.norm(r)), 1.0, np.zeros_like(r)
    if np.linalg.norm(r) > limit:
        for z, above, diagonal, below, _next in lanczos(A, r, Pl):
            factor = above / d if k else 0.0
            d = diagonal - factor * above
            if d <= 0:
                break
            w, p, k = (-factor * w if k else w), z - factor * p, k + 1
            x = x + w / d * p
            if below * abs(w / d) <= goal or k >= maxiters:
                break
    return _done(A, b, x, limit * 10, k, maxiters)


def _sides(A, At, Pl, Pr):
    """The operator with both preconditioners, which have to equal their adjoints here."""
    return (lambda x: Pl(A(Pr(x)))), (lambda y: Pr(At(Pl(y))))


def _two_sided_solve(A, b, At, Pl, Pr, x0, limit, maxiters, fold_of):
    x, r = _start(A, b, x0)
    op, adjoint = _sides(A, At, Pl, Pr)
    k = 0
    while np.linalg.norm(r) > limit and k < maxiters:  # after a breakdown or a goal met in the preconditioned norm: again from there
        before, start, at = np.linalg.norm(r), Pl(r), k
        goal = limit * np.linalg.norm(start) / before
        step, k = fold_of(op, adjoint, start, goal, k, maxiters)
        new = x + Pr(step)
        left = b - A(new)
        if not np.linalg.norm(left) < 0.99 * before:
            if np.linalg.norm(left) < before:
                x = new
            break
        x, r = new, left
        if k == at:
            break
    return _done(A, b, x, limit, k, maxiters)


@real
def qmr(A, b, *, At, Pl=_same, Pr=_same, x0=None, limit, maxiters, **_):
    """Quasi-minimal residuals over two-sided Lanczos vectors, by a short recurrence."""

    def fold_of(op, adjoint, start, goal, k, most):
        fold = LeastResidual(float(np.linalg.norm(start)), start)
        best, left, since = fold.x, np.inf, 0
        for v, above, diagonal, below, *_rest in two_sided(op, adjoint, start):
            k, since = k + 1, since + 1
            if not fold.add(v, above, diagonal, below):
                break
            if abs(fold.left) * np.sqrt(since + 1) <= goal or since % 10 == 0 or below == 0 or k >= most:
                now = np.linalg.norm(start - op(fold.x))
                if now < left:
                    best, left = fold.x, now
                if left <= goal or below == 0:
                    break
            if k >= most:
                break
        return best, k

    return _two_sided_solve(A, b, At, Pl, Pr, x0, limit, maxiters, fold_of)


@real
def bilq(A, b, *, At, Pl=_same, Pr=_same, x0=None, limit, maxiters, **_):
    """The LQ point of two-sided Lanczos, with the Galerkin point (that of BiCG) at the end."""

    def fold_of(op, adjoint, start, goal, k, most):
        fold, next_above = None, 0.0
        for v, _above, diagonal, below, _next, _w, above in two_sided(op, adjoint, start):
            if fold is None:
                fold = LeastError(float(np.linalg.norm(start)), v, diagonal)
            elif not fold.add(v, next_above, last_below, diagonal):
                break
            next_above, last_below, k = above, below, k + 1
            if below * abs(fold.last()) <= goal or k >= most:
                break
        if fold is None:
            return np.zeros_like(start), k
        points = [p for p in (fold.galerkin(), fold.x) if p is not None]
        return min(points, key=lambda p: np.linalg.norm(start - op(p))), k

    return _two_sided_solve(A, b, At, Pl, Pr, x0, limit, maxiters, fold_of)


def _usym(A, b, At, c, x0, limit, maxiters, n, least_residual: bool):
    x, r = _start(A, b, x0, n)
    start = np.array(c, float) if c is not None else r.copy() if n == len(b) else At(r)
    k, fold, beta = 0, None, float(np.linalg.norm(r))
    if least_residual:
        fold = LeastResidual(beta, np.zeros(n))
    last_below = next_above = 0.0
    if beta > limit:
        for u, _v, above, diagonal, below, after, next_u, _next_v in orthogonal(A, At, r, start):
            k += 1
            if least_residual:
                if not fold.add(u, above, diagonal, below) or abs(fold.left) <= limit or k >= maxiters:
                    break
                continue
            if fold is None:
                fold = LeastError(beta, u, diagonal)
            elif not fold.add(u, next_above, last_below, diagonal):
                break
            next_above, last_below = after, below
            if below * abs(fold.last()) <= limit or k >= maxiters:
                break
    if fold is None:
        return _done(A, b, x, limit, k, maxiters)
    points = [fold.x] if least_residual else [p for p in (fold.galerkin(), fold.x) if p is not None]
    best = min((x + p for p in points), key=lambda p: np.linalg.norm(b - A(p)))
    return _done(A, b, best, limit, k, maxiters)


@real
def usymqr(A, b, *, At, c=None, x0=None, limit, maxiters, n, **_):
    """Least residuals over the orthogonal tridiagonalisation; any shape."""
    return _usym(A, b, At, c, x0, limit, maxiters, n, True)


@real
def usymlq(A, b, *, At, c=None, x0=None, limit, maxiters, n, **_):
    """The LQ point of the orthogonal tridiagonalisation, with the Galerkin point at the end."""
    return _usym(A, b, At, c, x0, limit, maxiters, n, False)


def with_adjoint(method):
    """``method`` for A x = b, and the least-residual partner for A' t = c, whose solution goes to ``also["t"]``."""

    def run(A, b, *, At, c=None, also=None, limit, maxiters, n, **kw):
        x, code, k, r = method(A, b, At=At, limit=limit, maxiters=maxiters, n=n, **kw)
        if c is not None:
            partner = qmr if method is bilq else usymqr
            t, other, more, left = partner(At, np.asarray(c), At=A, limit=limit, maxiters=maxiters, n=len(b))
            if also is not None:
                also.update(t=t, t_retcode=other, t_resid=left)
            code, k = (code if not code.ok else other), max(k, more)
        return x, code, k, r

    return run


bilqr, trilqr = with_adjoint(bilq), with_adjoint(usymlq)


def _kept(A, r, steps):
    """An orthonormal Lanczos basis that is kept, and T with one row more."""
    V, T = [r / np.linalg.norm(r)], np.zeros((steps + 1, steps))
    for k in range(steps):
        w = A(V[k])
        for _ in range(2):
            h = np.array([v @ w for v in V])
            w = w - h @ np.array(V)
            T[: k + 1, k] += h
        T[k + 1, k] = np.linalg.norm(w)
        if T[k + 1, k] <= TINY * np.abs(T).max():
            T[k + 1, k] = 0.0
            return np.array(V), T[: k + 2, : k + 1], True
        V.append(w / T[k + 1, k])
    return np.array(V), T, False


def _rounds(A, b, x0, limit, maxiters, restart, small):
    """Restarted rounds over a kept basis; ``small`` gives y from T and the start's norm."""
    x, r = _start(A, b, x0)
    k = 0
    while np.linalg.norm(r) > limit and k < maxiters:
        before = np.linalg.norm(r)
        V, T, closed = _kept(A, r, min(restart, maxiters - k, len(b)))
        y = small(T, before)
        x = x + y @ V[: len(y)]
        r, k = b - A(x), k + T.shape[1]
        if closed or not np.linalg.norm(r) < before * (1 - 1e-10):
            break
    return x, r, k


@real
def minres_qlp(A, b, *, x0=None, limit, maxiters, restart=100, **_):
    """As MINRES, and of several solutions of a singular system the shortest; the basis is kept."""

    def small(T, beta):
        e = np.zeros(T.shape[0])
        e[0] = beta
        return np.linalg.lstsq(T, e, rcond=1e-12)[0]

    x, r, k = _rounds(A, b, x0, limit, maxiters, max(restart, 100), small)
    stationary = np.linalg.norm(A(r)) <= 1e-8 * max(1e-300, np.linalg.norm(r)) * max(1.0, np.linalg.norm(A(b)) / max(1e-300, np.linalg.norm(b)))
    if np.linalg.norm(r) > limit and stationary:
        return x, RetCode.SUCCESS, k, float(np.linalg.norm(r))  # inconsistent: a least-squares solution
    return _done(A, b, x, limit, k, maxiters)


@real
def minares(A, b, *, x0=None, limit, maxiters, restart=100, **_):
    """The least norm of A times the residual; the basis is kept."""

    def small(T, beta):
        k = T.shape[1]
        if k == 1 or T[k, k - 1] == 0:
            square = T[:k]
            e = np.zeros(k)
            e[0] = beta
            return np.linalg.lstsq(square @ square, square @ e, rcond=1e-14)[0]
        inner = T[:k, : k - 1]  # one step less: A times a vector of k coordinates has k + 1
        e = np.zeros(k)
        e[0] = beta
        return np.linalg.lstsq(T @ inner, T @ e, rcond=1e-14)[0]

    x, _r, k = _rounds(A, b, x0, limit, maxiters, max(restart, 100), small)
    return _done(A, b, x, limit, k, maxiters)


def _blocks(A, At, b, c, limit, maxiters, small):
    """x and y of a system of two blocks from kept orthogonal bases."""
    beta, gamma = float(np.linalg.norm(b)), float(np.linalg.norm(c))
    U, V, T = [], [], np.zeros((2, 1))
    x, y, left, k = np.zeros(len(b)), np.zeros(len(c)), np.hypot(beta, gamma), 0
    for u, v, above, diagonal, below, after, next_u, next_v in orthogonal(A, At, b, c, ([], [])):
        U, V = [*U, u], [*V, v]
        k = len(U)
        new = np.zeros((k + 1, k + 1))
        new[:k, :k] = T[:k, :k] if k > 1 else 0
        new[k - 1, k - 1], new[k, k - 1], new[k - 1, k] = diagonal, below, after
        if k > 1:
            new[k - 2, k - 1] = above
        T = new
        if k % 5 == 0 or next_u is None or next_v is None or k >= maxiters:
            if (next_u is None) != (next_v is None):  # one side has closed: with the other's next vector the space is complete
                V, U = (V, [*U, next_u]) if next_v is None else ([*V, next_v], U)
                p, q = small(T[: len(V), : len(U)], 0.0, 0.0, beta, gamma)
            else:
                p, q = small(T[:k, :k], T[k, k - 1], T[k - 1, k], beta, gamma)
            x, y = p @ np.array(V), q @ np.array(U)
            left = np.hypot(np.linalg.norm(b - x - A(y)), np.linalg.norm(c - At(x) + y))
            if left <= limit or k >= maxiters:
                break
    return x, y, k, float(left)


def _quasi_definite(T, below, after, beta, gamma, least: bool):
    m, n = T.shape
    whole = np.vstack([np.hstack([np.eye(m), T]), np.hstack([T.T, -np.eye(n)])])
    e = np.zeros(m + n)
    e[0], e[m] = beta, gamma
    if not least:
        z = np.linalg.solve(whole, e)
        return z[:m], z[m:]
    edge = np.zeros((2, m + n))
    edge[0, m + n - 1], edge[1, m - 1] = below, after
    z = np.linalg.lstsq(np.vstack([whole, edge]), np.append(e, [0, 0]), rcond=None)[0]
    return z[:m], z[m:]


def _coupled(least: bool):
    def run(A, b, *, At, c=None, also=None, limit, maxiters, n, **_):
        c = np.asarray(At(b) if c is None else c, float)
        x, y, k, left = _blocks(A, At, np.asarray(b, float), c, limit, maxiters, lambda T, p, q, be, ga: _quasi_definite(T, p, q, be, ga, least))
        if also is not None:
            also.update(y=y)
        return x, RetCode.SUCCESS if left <= limit else RetCode.MAXITERS if k >= maxiters else RetCode.CONVERGENCE_FAILURE, k, left

    return run


#: x + A y = b and A' x - y = c: Galerkin and least residuals over the orthogonal tridiagonalisation. y goes to ``also["y"]``.
tricg, trimr = _coupled(False), _coupled(True)


def gpmr(A, b, *, At, B=None, c=None, also=None, limit, maxiters, n, shift=1.0, other_shift=1.0, **_):
    """shift x + A y = b and B x + other_shift y = c with the least residual, over bases of an orthogonal Hessenberg reduction."""
    B = B or At
    b, c = np.asarray(b, float), np.asarray(At(b) if c is None else c, float)
    beta, gamma = float(np.linalg.norm(b)), float(np.linalg.norm(c))
    V, U = [b / beta if beta else b], [c / gamma if gamma else c]
    H, G = np.zeros((1, 0)), np.zeros((1, 0))
    x, y, left, k = np.zeros(len(b)), np.zeros(len(c)), np.hypot(beta, gamma), 0

    def grown(basis, w, M):
        h = np.zeros(len(basis) + 1)
        for _ in range(2):
            d = np.array([q @ w for q in basis])
            w, h[:-1] = w - d @ np.array(basis), h[:-1] + d
        h[-1] = np.linalg.norm(w)
        M = np.hstack([np.vstack([M, np.zeros((len(h) - len(M), M.shape[1]))]), h[:, None]])
        return w / h[-1] if h[-1] > TINY else np.zeros_like(w), M

    while left > limit and k < min(maxiters, len(b) + len(c)):
        v, H = grown(V, A(U[k]), H)
        u, G = grown(U, B(V[k]), G)
        k += 1
        top = np.hstack([shift * np.eye(k + 1, k), H])
        low = np.hstack([G, other_shift * np.eye(k + 1, k)])
        e = np.zeros(2 * k + 2)
        e[0], e[k + 1] = beta, gamma
        z = np.linalg.lstsq(np.vstack([top, low]), e, rcond=None)[0]
        x, y = z[:k] @ np.array(V), z[k:] @ np.array(U)
        left = float(np.linalg.norm(np.vstack([top, low]) @ z - e))
        V.append(v)
        U.append(u)
        if not v.any() and not u.any():
            break
    left = float(np.hypot(np.linalg.norm(b - shift * x - A(y)), np.linalg.norm(c - B(x) - other_shift * y)))
    if also is not None:
        also.update(y=y)
    return x, RetCode.SUCCESS if left <= limit * (1 + 1e-6) else RetCode.MAXITERS if k >= maxiters else RetCode.CONVERGENCE_FAILURE, k, left


def truncated(galerkin: bool):
    """Incomplete orthogonalisation against the last ``memory`` vectors, with directions in place of the basis."""

    def run(A, b, *, Pl=_same, Pr=_same, x0=None, limit, maxiters, memory=20, **_):
        x = np.zeros_like(b) if x0 is None else np.array(x0, b.dtype)
        r = b - A(x)
        k = 0
        while np.linalg.norm(r) > limit and k < maxiters:
            before, start = np.linalg.norm(r), Pl(r)
            size = np.linalg.norm(start)
            if size == 0:
                break
            goal = limit * size / before
            V, P, turns, z, lower, step = [start / size], [], [], size, 0.0, np.zeros_like(x)
            while k < maxiters:
                w = Pl(A(Pr(V[-1])))
                h = []
                for v in V:
                    h.append(np.vdot(v, w))
                    w = w - h[-1] * v
                below = np.linalg.norm(w)
                k += 1
                if galerkin:
                    u = list(h)
                    for i in range(len(u) - len(P), len(u)):  # the row above times its multiplier
                        if i > 0:
                            u[i] = u[i] - P[i - (len(u) - len(P))][2] * u[i - 1]
                    own = u[-1]
                    others = u[len(u) - 1 - len(P) : -1] if P else []
                    if abs(own) < TINY * max(1.0, below):
                        break
                    p = (Pr(V[-1]) - sum((c * q[0] for c, q in zip(others, P)), np.zeros_like(x))) / own
                    step = step + z * p
                    lower = below / own
                    z, left = -lower * z, abs(lower * z)
                    P = [*P, (p, own, lower)][-(memory - 1) :] if memory > 1 else []
                else:
                    column = [0.0 * h[0]] * (len(turns) + 1 - len(h)) + list(h)
                    for i, (c, s) in enumerate(turns):
                        column[i], column[i + 1] = c * column[i] + np.conj(s) * column[i + 1], -s * column[i] + c * column[i + 1]
                    own = column[-1]
                    length = np.hypot(abs(own), below)
                    if length == 0:
                        break
                    c, s = abs(own) / length, (below / length) * (np.conj(own) / abs(own) if own else 1.0)
                    p = (Pr(V[-1]) - sum((e * q for e, q in zip(column[:-1], P)), np.zeros_like(x))) / (c * own + np.conj(s) * below)
                    step = step + c * z * p
                    z = -s * z
                    left = abs(z) * np.sqrt(max(1, k - memory + 1))
                    turns, P = [*turns, (c, s)][-memory:], [*P, p][-memory:]
                if left <= goal or below <= TINY * size:
                    break
                V = [*V, w / below][-memory:]
            new = x + step
            after = np.linalg.norm(b - A(new))
            if not after < 0.999 * before:
                x = new if after < before else x
                break
            x, r = new, b - A(new)
        left = float(np.linalg.norm(b - A(x)))
        return x, RetCode.SUCCESS if left <= limit * (1 + 1e-6) else RetCode.MAXITERS if k >= maxiters else RetCode.CONVERGENCE_FAILURE, k, left

    return run


dqgmres, diom = truncated(False), truncated(True)
