"""Numpy kernels of the nucleosome model: exact partition function, marginals, samples, Metropolis trajectories.

The exact solver is a renewal recursion over start positions, in log space and for many molecules at once. With
w(x) = exp(-(e(x) - mu) / T) and r(g) = exp(-E(g) / T) for a gap g between starts (E: linker repulsion, zero from
W = footprint + linker range on): f(x) = w(x) (1 + sum of f over starts W or more before + sum of f(x - g) r(g)).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Settings:
    nucbp: int = 147
    llink: int | tuple[tuple[str, int], ...] = 40  # a range for all, or (chromosome, range) pairs; a dict is taken too
    elink: float = 1.0
    mu: float = 0.0
    temp: float = 1.0
    emax: float = np.inf

    def __post_init__(self) -> None:
        if isinstance(self.llink, dict):
            object.__setattr__(self, "llink", tuple(sorted((str(k), int(v)) for k, v in self.llink.items())))

    def of(self, chrom: str) -> Settings:
        """The settings of a chromosome; KeyError if its linker range is lacking."""
        return self if isinstance(self.llink, int) else replace(self, llink=dict(self.llink)[chrom])

    def repulsion(self) -> np.ndarray:
        """Energy of linkers of 0, 1, ... llink - 1 bp."""
        return self.elink * ((self.llink / np.arange(1, self.llink + 1)) ** 6 - 1) ** 2 if self.llink else np.empty(0)


def _sweep(lw: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each last start x (molecules x positions): log f(x), and the first two moments of the number of starts up to it."""
    n, npos = lw.shape
    far, lr = s.nucbp + s.llink, -s.repulsion() / s.temp
    out = np.full((n, npos), -np.inf)
    m1, m2 = np.zeros((n, npos)), np.zeros((n, npos))
    total, t1, t2 = np.zeros(n), np.zeros(n), np.zeros(n)  # log of 1 + f over starts at least `far` before; their mean moments
    for x in range(npos):
        if x >= far:
            y = x - far
            more = np.logaddexp(total, out[:, y])
            share = np.exp(out[:, y] - more)
            t1, t2, total = t1 + share * (m1[:, y] - t1), t2 + share * (m2[:, y] - t2), more
        best, a1, a2 = total, t1, t2
        if s.llink and x >= s.nucbp:
            near = slice(max(0, x - far + 1), x - s.nucbp + 1)
            part = out[:, near] + lr[: near.stop - near.start][::-1]
            top = np.maximum(part.max(1), total)
            weight, rest = np.exp(part - top[:, None]), np.exp(total - top)
            whole = weight.sum(1) + rest
            best = top + np.log(whole)
            a1 = (np.einsum("ij,ij->i", weight, m1[:, near]) + rest * t1) / whole
            a2 = (np.einsum("ij,ij->i", weight, m2[:, near]) + rest * t2) / whole
        out[:, x] = lw[:, x] + best
        m1[:, x], m2[:, x] = a1 + 1, a2 + 2 * a1 + 1
    return out, m1, m2


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def log_z(energy: np.ndarray, s: Settings) -> np.ndarray:
    """log Z of each molecule (rows of energies); NaN with a missing energy at a possible start."""
    energy = np.clip(np.atleast_2d(np.asarray(energy, float)), -s.emax, s.emax)
    npos = energy.shape[1] - s.nucbp + 1
    if npos <= 0:
        return np.zeros(len(energy))
    e = energy[:, :npos]
    gap = np.isnan(e).any(1)
    f, _, _ = _sweep(-(np.where(gap[:, None], 0, e) - s.mu) / s.temp, s)
    return np.where(gap, np.nan, np.logaddexp(0, _log_sum(f)))


def solve(energy: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """log Z, start probabilities, occupancy and its variance by position, mean count and its variance for each molecule
    (rows of energies).

    Molecules with a missing energy at a possible start give NaN in everything."""
    energy = np.clip(np.atleast_2d(np.asarray(energy, float)), -s.emax, s.emax)
    n, nbp = energy.shape
    npos = nbp - s.nucbp + 1
    if npos <= 0:
        return {"logz": np.zeros(n), "start": np.zeros((n, 0)), "occupancy": np.zeros((n, nbp)), "mean_n": np.zeros(n), "var_n": np.zeros(n), "var_occupancy": np.zeros((n, nbp))}
    gap = np.isnan(energy[:, :npos]).any(1)
    lw = -(np.where(gap[:, None], 0, energy[:, :npos]) - s.mu) / s.temp
    f, m1, m2 = _sweep(lw, s)
    logz = np.logaddexp(0, _log_sum(f))
    back = _sweep(lw[:, ::-1], s)[0][:, ::-1]
    start = np.exp(f + back - lw - logz[:, None])
    cum = np.concatenate([np.zeros((n, 1)), np.cumsum(start, 1)], 1)
    at = np.arange(nbp)
    occupancy = cum[:, np.minimum(at + 1, npos)] - cum[:, np.minimum(np.maximum(at - s.nucbp + 1, 0), npos)]
    last = np.exp(f - logz[:, None])  # probability that x is the last start
    mean, second = (last * m1).sum(1), (last * m2).sum(1)
    out = {"logz": logz, "start": start, "occupancy": occupancy, "mean_n": mean, "var_n": second - mean**2, "var_occupancy": occupancy * (1 - occupancy)}
    for v in out.values():
        v[gap] = np.nan
    return out


def sample(energy: np.ndarray, s: Settings, seed: int) -> list[int] | None:
    """One exact sample of start positions of a molecule, drawn from the left edge; None with a missing energy."""
    return samples(energy, s, [seed])[0]


def samples(energy: np.ndarray, s: Settings, seeds: list[int]) -> list[list[int] | None]:
    """Exact samples of one molecule, one a seed, from one solution."""
    npos = len(energy) - s.nucbp + 1
    if npos <= 0:
        return [[] for _ in seeds]
    e = np.clip(np.asarray(energy[:npos], float), -s.emax, s.emax)
    if np.isnan(e).any():
        return [None for _ in seeds]
    lw = -(e - s.mu)[None] / s.temp
    weight = _sweep(lw[:, ::-1], s)[0][0, ::-1]  # log of w(y) times everything to its right
    lr = -s.repulsion() / s.temp
    found = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        out: list[int] = []
        at = -s.nucbp - s.llink
        while True:
            y = np.arange(max(0, at + s.nucbp), npos)
            gap = y - at - s.nucbp
            lp = weight[y] + np.where(gap < s.llink, lr[np.minimum(gap, s.llink - 1)] if s.llink else 0.0, 0.0)
            p = np.cumsum(np.exp(np.append(lp, 0.0) - max(lp.max(initial=0.0), 0.0)))
            k = int(np.searchsorted(p, rng.random() * p[-1], side="right"))
            if k >= len(y):
                break
            at = int(y[k])
            out.append(at)
        found.append(out)
    return found


def config_energy(positions: list[int], energy: np.ndarray, s: Settings) -> float:
    rep = s.repulsion()
    gaps = [b - a - s.nucbp for a, b in zip(positions, positions[1:], strict=False)]
    return float(sum(np.clip(energy[p], -s.emax, s.emax) for p in positions) + sum(rep[g] for g in gaps if g < s.llink) - s.mu * len(positions))


BLOCK = 512  #: moves that random numbers are drawn for at a time
_FAR = 1 << 40


def metropolis(energy: np.ndarray, s: Settings, nsweep: int, start_temp: float, seed: int, cooling: str = "linear", freq: int = 1) -> list[tuple[int, float, float, list[int]]]:
    """Frames (time, energy, temperature, positions) of one run."""
    return [f[1:] for f in metropolis_runs(np.asarray(energy, float)[None], s, nsweep, start_temp, [seed], cooling, freq)]


def metropolis_runs(energy: np.ndarray, s: Settings, nsweep: int, start_temp: float, seeds: list[int], cooling: str = "linear", freq: int = 1) -> list[tuple[int, int, float, float, list[int]]]:
    """Frames (run, time, energy, temperature, positions) of several runs, a row of energies and a seed each: the empty fiber,
    then every `freq` sweeps of 3 moves a position. All runs move in step; each draws from its own seed, so a run's frames
    don't depend on the others. Runs with a missing energy at a possible start have no frames."""
    if cooling not in ("linear", "geometric", "constant"):
        raise ValueError("cooling is linear, geometric or constant")
    energy = np.clip(np.atleast_2d(np.asarray(energy, float)), -s.emax, s.emax)
    npos = max(energy.shape[1] - s.nucbp + 1, 0)
    keep = np.flatnonzero(~np.isnan(energy[:, :npos]).any(1))
    e, rngs, n = energy[keep, :npos], [np.random.default_rng(seeds[i]) for i in keep], len(keep)
    reps = np.append(s.repulsion(), 0.0)
    wide = npos // s.nucbp + 3
    pos = np.full((n, wide + 1), _FAR)  # -far, starts in order, far ...
    pos[:, 0] = -_FAR
    count = np.zeros(n, "i8")
    columns = np.arange(wide + 1)
    frames = [(int(i), 0, 0.0, float(start_temp), []) for i in keep]

    def rep(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        gap = right - left - s.nucbp
        return np.where(gap < 0, np.inf, reps[np.clip(gap, 0, s.llink)])

    def move(u: np.ndarray, temp: float) -> None:
        mode = (3 * u[:, 0]).astype("i1")
        has = count > 0
        r = np.flatnonzero((mode == 0) & has)
        if len(r):
            k = (u[r, 1] * count[r]).astype("i8") + 1
            old, left, right = pos[r, k], pos[r, k - 1], pos[r, k + 1]
            new = old + np.where(u[r, 2] < 0.5, 1, -1)
            inside = (new >= 0) & (new < npos)
            there = np.where(inside, new, old)
            rise = e[r, there] - e[r, old] + rep(left, there) + rep(there, right) - rep(left, old) - rep(old, right)
            ok = inside & (u[r, 3] < np.exp(np.minimum(0, -rise / temp)))
            pos[r[ok], k[ok]] = new[ok]
        r = np.flatnonzero(mode == 1)
        if len(r):
            p = (u[r, 1] * npos).astype("i8")
            k = (pos[r, 1:] < p[:, None]).sum(1) + 1
            left, right = pos[r, k - 1], pos[r, k]
            rise = e[r, p] + rep(left, p) + rep(p, right) - rep(left, right)
            ok = u[r, 3] < npos / (count[r] + 1) * np.exp(np.minimum(50, (s.mu - rise) / temp))
            r, k, p = r[ok], k[ok, None], p[ok]
            if len(r):
                held = pos[r]
                pos[r] = np.where(columns < k, held, np.where(columns == k, p[:, None], np.roll(held, 1, 1)))
                count[r] += 1
        r = np.flatnonzero((mode == 2) & has)
        if len(r):
            k = (u[r, 1] * count[r]).astype("i8") + 1
            p, left, right = pos[r, k], pos[r, k - 1], pos[r, k + 1]
            freed = e[r, p] + rep(left, p) + rep(p, right) - rep(left, right)
            ok = u[r, 3] < count[r] / npos * np.exp(np.minimum(50, (freed - s.mu) / temp))
            r, k = r[ok], k[ok, None]
            if len(r):
                held = pos[r]
                pos[r] = np.where(columns < k, held, np.append(held[:, 1:], np.full((len(r), 1), _FAR), 1))
                count[r] -= 1

    for t in range(1, nsweep + 1 if n else 0):
        progress = (t - 1) / (nsweep - 1) if nsweep > 1 else 1.0
        temp = {"linear": start_temp + (s.temp - start_temp) * progress, "geometric": start_temp * (s.temp / start_temp) ** progress, "constant": start_temp}[cooling]
        for lo in range(0, 3 * npos, BLOCK):
            draws = np.stack([g.random((min(BLOCK, 3 * npos - lo), 4)) for g in rngs], 1)
            for u in draws:
                move(u, temp)
        if t % freq == 0:
            for i, p, c in zip(keep.tolist(), pos, count.tolist(), strict=True):
                starts = p[1 : c + 1].tolist()
                frames.append((i, t, config_energy(starts, energy[i], s), float(temp), starts))
    return frames


def run_seed(master: int, chrom: int, mol: int, run: int) -> int:
    """The seed of a run, whatever the order or number of workers."""
    return int(np.random.SeedSequence(entropy=master, spawn_key=(chrom, mol, run)).generate_state(1)[0])
