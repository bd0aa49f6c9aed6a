"""A small gated recurrent unit in numpy: forward, backpropagation through time, Adam.

Arrays are features-first, ``(features, lanes)``; every lane is an independent
sequence.  The squashing function is softsign, ``x / (1 + |x|)``, for the candidate and
its affine image on (0, 1) for the gates: a few vectorised operations per step.

    r, z = gate(U[:, x] + W h)        n = softsign(U_n[:, x] + r * (W_n h))
    h'   = z * h + (1 - z) * n
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def init(hidden: int, symbols: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    u = rng.normal(0, 0.3, (3 * hidden, symbols)).astype(F32)
    w = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(F32)
    return {"U": u, "W": w}


def step(u_cols: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step without a tape; ``u_cols`` is U[:, x] (overwritten)."""
    k = h.shape[0]
    g = w @ h
    gates = u_cols[:2 * k]
    gates += g[:2 * k]
    gates /= 1 + np.abs(gates)
    gates *= 0.5
    gates += 0.5
    n = g[2 * k:]
    n *= gates[:k]
    n += u_cols[2 * k:]
    n /= 1 + np.abs(n)
    h = h - n
    h *= gates[k:]
    h += n
    return h


def forward(p: dict, x: np.ndarray, h: np.ndarray):
    """Run over ``x`` (T, lanes); returns states (T, H, lanes) and the tape."""
    k, steps = h.shape[0], (len(x), *h.shape)
    states, news, inner, rest = (np.empty(steps, h.dtype) for _ in range(4))
    signs, gates = np.empty((len(x), 2 * k, h.shape[1]), h.dtype), np.empty((len(x), 2 * k, h.shape[1]), h.dtype)
    g, size = np.empty((3 * k, h.shape[1]), h.dtype), np.empty((2 * k, h.shape[1]), h.dtype)
    columns, first = np.take(p["U"], x, axis=1, mode="clip"), h
    for t in range(len(x)):
        np.matmul(p["W"], h, out=g)
        a, s, rz, n, c = columns[:, t], signs[t], gates[t], news[t], rest[t]
        np.add(a[:2 * k], g[:2 * k], out=s)
        np.abs(s, out=size)
        size += 1
        s /= size
        np.multiply(s, 0.5, out=rz)
        rz += 0.5
        inner[t] = g[2 * k:]
        np.multiply(rz[:k], inner[t], out=n)
        n += a[2 * k:]
        np.abs(n, out=size[:k])
        size[:k] += 1
        n /= size[:k]
        np.subtract(1, rz[k:], out=c)
        np.multiply(c, n, out=size[:k])
        h = np.multiply(rz[k:], h, out=states[t])
        h += size[:k]
    return states, (first, states, signs, gates, news, inner, rest)


def backward(p: dict, x: np.ndarray, tape: tuple, d_states: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for dLoss/dstates (T, H, lanes): backpropagation through time."""
    k, lanes = d_states.shape[1:]
    first, states, signs, gates, news, inner, rest = tape
    before = np.concatenate([first[None], states[:-1]])
    slope_n, slope_s = (1 - np.abs(news)) ** 2, 0.5 * (1 - np.abs(signs)) ** 2
    drop = before - news
    dgs, dns = np.empty((len(x), 3 * k, lanes), d_states.dtype), np.empty(d_states.shape, d_states.dtype)
    dh, through = np.zeros((k, lanes), d_states.dtype), np.empty((k, lanes), d_states.dtype)
    back = np.ascontiguousarray(p["W"].T)
    for t in range(len(x) - 1, -1, -1):
        dg, dn = dgs[t], dns[t]
        dh += d_states[t]
        np.multiply(dh, rest[t], out=dn)
        dn *= slope_n[t]
        np.multiply(dn, inner[t], out=dg[:k])
        np.multiply(dh, drop[t], out=dg[k:2 * k])
        dg[:2 * k] *= slope_s[t]
        np.multiply(dn, gates[t, :k], out=dg[2 * k:])
        dh *= gates[t, k:]
        dh += np.matmul(back, dg, out=through)
    flat = np.empty((len(x), lanes, 3 * k), d_states.dtype)
    flat[:, :, :2 * k] = dgs[:, :2 * k].transpose(0, 2, 1)
    flat[:, :, 2 * k:] = dns.transpose(0, 2, 1)
    dw = np.matmul(dgs, before.transpose(0, 2, 1))[::-1].sum(axis=0)
    return {"U": sum_by(x.ravel(), flat.reshape(-1, 3 * k), p["U"].shape[1]).T, "W": dw}


def sum_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum ``rows`` by integer key into (n, width)."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(keys):
        order = np.argsort(keys.astype(np.min_scalar_type(n)), kind="stable")  # small integers sort by radix
        at = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
        out[keys[order][at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    e /= e.sum(axis=axis, keepdims=True)
    return e


class Adam:
    """Adam with gradient clipping by global norm, over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.p, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m, self.v = ({k: np.zeros(v.shape, v.dtype) for k, v in params.items()} for _ in range(2))
        self.scratch = {k: (np.empty(v.shape, v.dtype), np.empty(v.shape, v.dtype)) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = F32(min(1.0, self.clip / max(norm, 1e-9)))
        rate = F32(self.rate * scale * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t))
        for k, raw in grads.items():
            m, v, (g, part) = self.m[k], self.v[k], self.scratch[k]
            np.multiply(raw, shrink, out=g)
            m *= F32(0.9)
            m += np.multiply(g, F32(0.1), out=part)
            v *= F32(0.999)
            np.multiply(g, F32(0.001), out=part)
            part *= g
            v += part
            np.sqrt(v, out=part)
            part += F32(1e-8)
            np.multiply(m, rate, out=g)
            g /= part
            self.p[k] -= g
