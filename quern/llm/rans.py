"""Static range asymmetric numeral systems over token ids, interleaved across lanes of a numpy vector.

A table gives each id of a segment a frequency out of 2**BITS. A block is coded on its own: ids are dealt over
``lanes`` states, and in every step all lanes code one id each; a lane whose state would grow beyond 2**63 first
puts 32 bits on the block's one word stream, in lane order. Checkpoints keep the lanes' states and the stream's
position every ``every`` steps, so the parts of a block decode apart from each other.
"""

from __future__ import annotations

import numpy as np

BITS, LOW = 20, 1 << 31
U = np.uint64


def table(ids: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): all of ``ids``, each at least 1, frequencies adding up to 2**bits."""
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary: counting by id is cheaper than sorting
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts = every[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    return symbols.astype(np.uint32), normalise(counts, bits)


def normalise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than the table has places")
    if not len(counts):
        return counts.astype(np.uint32)
    freq = np.maximum(1, counts.astype(np.int64) * total // counts.sum())
    # Give what is missing to, or take what is too much from, the most frequent: the least relative change.
    order = np.argsort(-freq, kind="stable")
    spare = total - int(freq.sum())
    if spare >= 0:
        freq[order[0]] += spare
    else:
        for k in order:
            cut = min(-spare, int(freq[k]) - 1)
            freq[k] -= cut
            spare += cut
            if not spare:
                break
    return freq.astype(np.uint32)


def encode(ranks: np.ndarray, freq: np.ndarray, lanes: int, every: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, checkpoint states, checkpoint positions) for ``ranks`` (places in the table).

    Checkpoint k holds what a decoder needs to start at step k * every.
    """
    n = len(ranks)
    steps = -(-n // lanes)
    f = freq.astype(U)
    start = np.concatenate(([U(0)], np.cumsum(f)[:-1])) if len(f) else f
    limit = f << U(63 - bits)
    state = np.full(lanes, LOW, dtype=U)
    out: list[np.ndarray] = []
    written, states, places = 0, [], []
    for step in range(steps - 1, -1, -1):
        r = ranks[step * lanes : (step + 1) * lanes]
        s = state[: len(r)]
        full = s >= limit[r]
        if full.any():
            words = (s[full] & U(0xFFFFFFFF)).astype(np.uint32)
            out.append(words)
            written += len(words)
            s = np.where(full, s >> U(32), s)
        q, m = np.divmod(s, f[r])
        state[: len(r)] = (q << U(bits)) + m + start[r]
        if step % every == 0:
            states.append(state.copy())
            places.append(written)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return words, np.array(states[::-1], dtype=U).reshape(-1, lanes), np.array([written - p for p in places[::-1]], dtype=np.int64)


def slots(freq: np.ndarray) -> np.ndarray:
    """The rank of every place of the table: built once per segment."""
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def decode(words: np.ndarray, states: np.ndarray, places: np.ndarray, freq: np.ndarray, slot: np.ndarray, n: int, lanes: int, every: int,
           part: int | None = None, bits: int = BITS) -> np.ndarray:
    """The ranks of a block, or of the steps between checkpoint ``part`` and the next. The parts of a block, each from its own
    checkpoint, decode side by side, one step of all of them at a time."""
    steps = -(-n // lanes)
    first, last = (0, len(places)) if part is None else (part, part + 1)
    f = freq.astype(U)
    start = np.concatenate(([U(0)], np.cumsum(f)[:-1]))
    state, at = states[first:last].copy(), places[first:last].copy()
    # The last part may have fewer steps, and its last step fewer lanes.
    length = np.minimum(every, steps - every * np.arange(first, last))
    out = np.zeros((last - first, every, lanes), np.uint32)
    mask = U((1 << bits) - 1)
    for step in range(int(length.max(initial=0))):
        k = last - first if step < length[-1] else last - first - 1
        s = state[:k]
        low = s & mask
        r = slot[low.astype(np.int64)]
        s = f[r] * (s >> U(bits)) + low - start[r]
        need = s < U(LOW)
        if last == len(places) and k == last - first and (last - 1) * every + step == steps - 1:
            need[-1, n - (steps - 1) * lanes :] = False
        row, lane = np.nonzero(need)
        if len(row):
            taken = need.sum(axis=1)
            before = np.cumsum(taken) - taken
            s[row, lane] = (s[row, lane] << U(32)) | words[at[row] + np.arange(len(row)) - before[row]].astype(U)
            at[:k] += taken
        state[:k] = s
        out[:k, step] = r
    return out.reshape(-1)[: min(n, last * every * lanes) - first * every * lanes]
