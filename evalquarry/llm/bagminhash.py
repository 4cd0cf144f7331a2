"""BagMinHash signatures of many multisets at once.

An element of a multiset owns, for each dyadic block of weight levels (0,1],
(1,2], (2,4], (4,8] ..., a Poisson process in time whose rate is the block's
width; each point has a random level of the block and a random register. The
levels are the discretised weights, and halving a block halves its process, so a
point of a block that a weight covers in part counts if its level is covered. A
register keeps the first point that any covered level sends to it. Two multisets
agree in a register with a probability equal to their weighted Jaccard index.
"""

from __future__ import annotations

import numpy as np

from .packed import U64, mix, ranges

REGISTERS = 100


def processes(element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block below an element's weight: the element's place, least level, width."""
    blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1
    place = np.repeat(np.arange(len(element)), blocks)
    k = ranges(np.zeros(len(element), np.int64), blocks)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    return place, low, np.maximum(low, 1)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, owners: int, m: int = REGISTERS) -> np.ndarray:
    """An owners x m table of point identities; owners without elements have zeros.

    owner, element and weight have a row for each distinct element of each owner.
    """
    place, low, width = processes(element, weight)
    doc = owner[place]
    state = mix(element[place] ^ mix(low.astype(U64), 31), 32)
    most = weight[place]
    time, step = np.zeros(len(place)), np.zeros(len(place), U64)
    best, name = np.full(owners * m, np.inf), np.zeros(owners * m, U64)
    total = np.bincount(owner, weights=weight, minlength=owners)
    with np.errstate(divide="ignore"):
        until = m * (np.log(m) + 2) / total
    live = np.arange(len(place))  # processes whose last drawn point is before their document's horizon
    while len(live):
        rate = width[live]
        draws = np.ceil((until[doc[live]] - time[live]) * rate * 1.1 + 1).astype(np.int64)
        who = np.repeat(live, draws)
        count = ranges(np.zeros(len(live), np.int64), draws).astype(U64) + step[who]
        point = mix(state[who] + count * U64(0x9E3779B97F4A7C15), 33)
        gap = -np.log(((point >> U64(11)).astype(float) + 0.5) * 2.0**-53) / width[who]
        ends = np.cumsum(draws)
        sums = np.cumsum(gap)
        at = sums - np.repeat(sums[ends - 1] - np.add.reduceat(gap, ends - draws), draws) + time[who]
        other = mix(point, 34)
        level = low[who] + 1 + (other >> U64(40)).astype(np.int64) % width[who]
        register = doc[who] * m + ((other & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)
        counts = level <= most[who]
        register, at_, id_ = register[counts], at[counts], point[counts]
        np.minimum.at(best, register, at_)
        won = best[register] == at_
        name[register[won]] = id_[won]
        time[live], step[live] = at[ends - 1], step[live] + draws.astype(U64)
        # registers that are still empty, or whose point may yet be beaten, push the horizon
        worst = best.reshape(owners, m).max(axis=1)
        empty = ~np.isfinite(worst)
        until = np.where(empty, until * 1.5, np.minimum(until, worst))
        behind = np.arange(len(place)) if empty.any() else live
        live = behind[(time[behind] < until[doc[behind]]) & (total[doc[behind]] > 0)]
    return name.reshape(owners, m)


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of registers of each signature; equal bands of different numbers differ."""
    rows = table.shape[1] // bands
    out = np.zeros((len(table), bands), U64)
    for r in range(rows):
        out = mix(out ^ table[:, r::rows][:, :bands], 41)
    return mix(out ^ mix(np.arange(bands, dtype=U64), 42), 43)
