"""A gated recurrent network in numpy that predicts words through classes.

An input word selects a row of gate inputs; a state of ``HIDDEN`` numbers passes update,
reset and candidate gates.  The output is factored: a softmax over classes, and within a
class of frequent words a softmax over its members.  Rare words have classes of their own,
told by the word's ending; their share inside the class comes from counts, not from here.

Training is truncated backpropagation: documents run in pieces of ``STEPS`` words, the state is
carried from piece to piece and gradients stop at the seam.
"""

import heapq
from typing import NamedTuple

import numpy as np

HIDDEN = 32
#: Classes of frequent words, words in each, and classes of rare words.
CLASSES, MEMBERS, RARE = 32, 64, 64
FREQUENT = CLASSES * MEMBERS
STEPS, LANES = 16, 256
NOWHERE = np.float32(-1e9)

SHAPES = {
    "inputs": (FREQUENT + RARE, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN),
    "class_w": (HIDDEN, CLASSES + RARE), "class_b": (CLASSES + RARE,),
    "word_w": (CLASSES, HIDDEN, MEMBERS), "word_b": (CLASSES, MEMBERS),
}
Weights = dict[str, np.ndarray]


def initial(frequent: np.ndarray, rare: np.ndarray, seed: int = 7) -> Weights:
    """Weights whose predictions are the counts of frequent words and rare classes, state aside."""
    random = np.random.default_rng(seed)
    counts = np.zeros(FREQUENT)
    counts[: len(frequent)] = frequent
    words = counts.reshape(CLASSES, MEMBERS)
    exists = (np.arange(FREQUENT) < max(1, len(frequent))).reshape(CLASSES, MEMBERS)
    classes = np.concatenate([words.sum(axis=1), rare]) + 1.0
    weights = {
        "inputs": random.normal(0, 0.3, SHAPES["inputs"]), "recur": random.normal(0, HIDDEN**-0.5, SHAPES["recur"]),
        "class_w": np.zeros(SHAPES["class_w"]), "class_b": np.log(classes / classes.sum()),
        "word_w": np.zeros(SHAPES["word_w"]), "word_b": np.where(exists, np.log(words + 1), NOWHERE),
    }
    weights["class_b"][:CLASSES][~exists.any(axis=1)] = NOWHERE
    return {n: w.astype(np.float32) for n, w in weights.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    sizes = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {n: p.reshape(s).astype(np.float32) for (n, s), p in zip(SHAPES.items(), np.split(values, sizes[:-1]))}


def class_of(ids: np.ndarray) -> np.ndarray:
    """Ids below FREQUENT are words, in order of frequency; the others are rare classes."""
    return np.where(ids < FREQUENT, ids // MEMBERS, ids - FREQUENT + CLASSES)


def _advance(weights: Weights, gates: np.ndarray, state: np.ndarray):
    """One step: new state, and what its gradient needs."""
    recur = state @ weights["recur"]
    both = np.tanh(0.5 * (gates[:, : 2 * HIDDEN] + recur[:, : 2 * HIDDEN]))
    both *= 0.5
    both += 0.5
    update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
    inner = recur[:, 2 * HIDDEN :]
    candidate = np.tanh(gates[:, 2 * HIDDEN :] + reset * inner)
    return candidate + update * (state - candidate), (update, reset, candidate, inner)


def _parted(weights: Weights) -> tuple[np.ndarray, ...]:
    """Gate inputs and recurrence in parts: update and reset, halved (sigmoid(x) is (tanh(x / 2) + 1) / 2), and candidate."""
    inputs, recur = weights["inputs"], weights["recur"]
    gates = slice(None, 2 * HIDDEN), slice(2 * HIDDEN, None)
    half = np.float32(0.5)
    return inputs[:, gates[0]] * half, inputs[:, gates[1]].copy(), recur[:, gates[0]] * half, recur[:, gates[1]].copy()


def _follow(parts: tuple[np.ndarray, ...], words: np.ndarray, state: np.ndarray) -> np.ndarray:
    """``_advance`` on parted weights, for scoring."""
    gate_inputs, inputs, gate_recur, recur = parts
    both = gate_inputs.take(words, axis=0)
    both += state @ gate_recur
    np.tanh(both, out=both)
    both += 1
    both *= 0.5
    candidate = state @ recur
    candidate *= both[:, HIDDEN:]
    candidate += inputs.take(words, axis=0)
    np.tanh(candidate, out=candidate)
    state = state - candidate
    state *= both[:, :HIDDEN]
    state += candidate
    return state


def _softmax(logits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place; ``held`` is room of the same size."""
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits, out=held).sum(axis=1, keepdims=True))
    return np.exp(logits, out=logits)


def _by_class(ids: np.ndarray):
    """Positions of the targets that are frequent words, ordered by class, and (class, part of them) for each class that occurs."""
    words = np.flatnonzero(ids < FREQUENT)
    order = words[np.argsort(ids[words], kind="stable")]
    classes = ids[order] // MEMBERS
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(order) else np.zeros(0, int)
    return order, [(int(classes[a]), slice(int(a), int(b))) for a, b in zip(starts, np.r_[starts[1:], len(order)])]


def _member_logits(weights: Weights, states: np.ndarray, parts: list[tuple[int, slice]], logits: np.ndarray) -> np.ndarray:
    """Logits of the members of each state's class; states are ordered by class."""
    for c, part in parts:
        np.matmul(states[part], weights["word_w"][c], out=logits[part])
        logits[part] += weights["word_b"][c]
    return logits


def _picked(logits: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Log softmax at one place of each row; ``small`` logits need no shift to be exponentiated."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(at)), at].astype(float)
    return chosen - np.log(np.exp(logits, out=logits).sum(axis=1))


def has_small_logits(weights: Weights) -> bool:
    """Whether no state, whose numbers lie between -1 and 1, can give a logit near the limits of 32 bits."""
    classes = np.abs(weights["class_w"]).sum(axis=0).max() + weights["class_b"].max()
    words = (np.abs(weights["word_w"]).sum(axis=1) + weights["word_b"]).max()
    lowest = np.where(weights["class_b"] > NOWHERE / 2, weights["class_b"], np.inf).min() - np.abs(weights["class_w"]).sum(axis=0).max()
    return bool(max(classes, words) < 60 and lowest > -60)


def log_probabilities(weights: Weights, states: np.ndarray, ids: np.ndarray, small: bool = False) -> np.ndarray:
    """Natural log probability of each target's class and, for a frequent word, of the word in it."""
    logits = states @ weights["class_w"]
    logits += weights["class_b"]
    logs = _picked(logits, class_of(ids), small)
    order, parts = _by_class(ids)
    logs[order] += _picked(_member_logits(weights, states[order], parts, np.empty((len(order), MEMBERS), logits.dtype)), ids[order] % MEMBERS, small)
    return logs


# --- training -------------------------------------------------------------------------


class Trainer:
    """Adagrad over documents laid in lanes."""

    def __init__(self, weights: Weights, rate: float = 0.08):
        self.weights = {n: w.copy() for n, w in weights.items()}
        self.squares = {n: np.full(w.shape, 1e-4, np.float32) for n, w in weights.items()}
        self.rate = rate
        self.words = 0
        self.size: tuple[int, int] | None = None

    def learn(self, documents: list[np.ndarray], first: int) -> None:
        """Run through all documents once, in consecutive pieces of ``STEPS`` words, the state carried from piece to piece."""
        laid = lanes_of(documents, first, LANES)
        if laid is None:
            return
        inputs, targets, owners, carried = laid
        state = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for start in range(0, len(inputs), STEPS):
            part = slice(start, start + STEPS)
            state = self._piece(inputs[part], targets[part], owners[part] >= 0, carried[part], state)
        self.words += int((owners >= 0).sum())

    def _piece(self, inputs, targets, real, carried, state):
        w = self.weights
        steps, lanes = inputs.shape
        room = self._room(steps, lanes)
        fresh = (carried == 0).any(axis=1)
        befores, states, recurs, candidates = (room[n] for n in ("befores", "states", "recurs", "candidates"))
        gates = np.take(w["inputs"], inputs, axis=0, out=room["gates"], mode="clip")
        # What a step reads lies contiguous: its loops over so few lanes cost more than their arithmetic.
        boths, lasts = gates[:, :, : 2 * HIDDEN].copy(), gates[:, :, 2 * HIDDEN :].copy()
        for t, (both, candidate, own) in enumerate(zip(boths, candidates, recurs)):
            if fresh[t]:
                state = state * carried[t][:, None]
            befores[t] = state
            np.matmul(state, w["recur"], out=own)
            both += own[:, : 2 * HIDDEN]
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            np.multiply(both[:, HIDDEN:], own[:, 2 * HIDDEN :], out=candidate)
            candidate += lasts[t]
            np.tanh(candidate, out=candidate)
            state = np.subtract(state, candidate, out=states[t])
            state *= both[:, :HIDDEN]
            state += candidate
        flat_states, ids, share = states.reshape(-1, HIDDEN), targets.ravel(), real.ravel().astype(np.float32)
        share = share / max(1.0, float(share.sum()))
        grads = {}
        errors = np.matmul(flat_states, w["class_w"], out=room["classes"])
        errors += w["class_b"]
        errors = _softmax(errors, room["held"])
        errors[np.arange(len(ids)), class_of(ids)] -= 1
        errors *= share[:, None]
        grads["class_w"], grads["class_b"] = flat_states.T @ errors, errors.sum(axis=0)
        back = errors @ w["class_w"].T
        grads["word_w"], grads["word_b"] = np.zeros_like(w["word_w"]), np.zeros_like(w["word_b"])
        order, parts = _by_class(ids)
        own_states, through = flat_states[order], np.empty((len(order), HIDDEN), np.float32)
        members = _member_logits(w, own_states, parts, room["members"][: len(order)])
        members = _softmax(members, room["members_held"][: len(order)])
        members[np.arange(len(order)), ids[order] % MEMBERS] -= 1
        members *= share[order, None]
        for c, part in parts:
            own = members[part]
            grads["word_w"][c], grads["word_b"][c] = own_states[part].T @ own, own.sum(axis=0)
            np.matmul(own, w["word_w"][c].T, out=through[part])
        back[order] += through
        back = back.reshape(steps, lanes, HIDDEN)
        throughs, insides = room["throughs"], room["insides"]
        update, reset, inner = boths[:, :, :HIDDEN].copy(), boths[:, :, HIDDEN:].copy(), recurs[:, :, 2 * HIDDEN :].copy()
        unmoved, unreset, slope = 1 - update, 1 - reset, 1 - candidates * candidates
        moved = befores - candidates
        later, held, recur = np.zeros((lanes, HIDDEN), np.float32), np.empty((lanes, HIDDEN), np.float32), w["recur"].T
        for t in range(steps - 1, -1, -1):
            total, inside, through, stays = back[t], insides[t], throughs[t], update[t]
            total += later
            np.multiply(total, unmoved[t], out=inside)
            inside *= slope[t]
            np.multiply(total, moved[t], out=held)
            held *= stays
            np.multiply(held, unmoved[t], out=through[:, :HIDDEN])
            np.multiply(inside, inner[t], out=held)
            held *= reset[t]
            np.multiply(held, unreset[t], out=through[:, HIDDEN : 2 * HIDDEN])
            np.multiply(inside, reset[t], out=through[:, 2 * HIDDEN :])
            np.matmul(through, recur, out=later)
            total *= stays
            later += total
            if fresh[t]:
                later *= carried[t][:, None]
        grads["recur"] = befores.reshape(-1, HIDDEN).T @ throughs.reshape(-1, 3 * HIDDEN)
        throughs[:, :, 2 * HIDDEN :] = insides  # from here on the gradients of the gates
        rows = inputs.ravel()
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
        sums = np.add.reduceat(throughs.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
        self._step("inputs", sums, rows[order][starts])
        for name, grad in grads.items():
            self._step(name, grad, ...)
        return state.copy()

    def _room(self, steps: int, lanes: int) -> dict[str, np.ndarray]:
        """Arrays that every piece of this size uses again."""
        if (steps, lanes) != self.size:
            wide, narrow, flat_size = (steps, lanes, 3 * HIDDEN), (steps, lanes, HIDDEN), steps * lanes
            shapes = {n: narrow for n in ("befores", "states", "candidates", "insides")} | {n: wide for n in ("gates", "recurs", "throughs")}
            shapes |= {n: (flat_size, CLASSES + RARE) for n in ("classes", "held")} | {n: (flat_size, MEMBERS) for n in ("members", "members_held")}
            self.size, self.room = (steps, lanes), {n: np.empty(shape, np.float32) for n, shape in shapes.items()}
        return self.room

    def _step(self, name: str, grad: np.ndarray, at) -> None:
        held = grad * grad
        norm = float(np.sqrt(held.sum()))
        if norm > 1:
            grad = grad / norm
            np.multiply(grad, grad, out=held)
        held += self.squares[name][at]
        self.squares[name][at] = held
        change = self.rate * grad
        change /= np.sqrt(held, out=held)
        self.weights[name][at] -= change


# --- scoring --------------------------------------------------------------------------


def lanes_of(documents: list[np.ndarray], first: int, most_lanes: int):
    """Documents behind each other in lanes of about equal length: inputs, targets, owners, carried, as (time, lane).

    ``first`` is the input before a document; ``carried`` is 0 where one begins, and the state is cleared.
    ``owners`` is the document of each place, -1 behind a lane's last.
    """
    lengths = np.array([len(d) for d in documents])
    if not lengths.sum():
        return None
    lanes = int(np.clip(lengths.sum() // max(1, lengths.max()), 1, most_lanes))
    heap = [(0, lane, []) for lane in range(lanes)]
    for d in np.argsort(-lengths, kind="stable"):
        size, lane, held = heap[0]
        held.append(int(d))
        heapq.heapreplace(heap, (size + int(lengths[d]), lane, held))
    longest = max(size for size, _, _ in heap)
    targets, owners = np.zeros((longest, lanes), np.int32), np.full((longest, lanes), -1, np.int32)
    inputs, carried = np.zeros((longest, lanes), np.int32), np.ones((longest, lanes), np.float32)
    for _, lane, held in heap:
        at = 0
        for d in held:
            stop = at + len(documents[d])
            targets[at:stop, lane], owners[at:stop, lane] = documents[d], d
            if stop > at:
                inputs[at, lane], carried[at, lane] = first, 0
                inputs[at + 1 : stop, lane] = documents[d][:-1]
            at = stop
    return inputs, targets, owners, carried


def score(weights: Weights, documents: list[np.ndarray], first: int, most_lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of each sequence of target ids, ``first`` being the input before them.

    The state is carried through all windows of a sequence.
    """
    total = np.zeros(len(documents))
    laid = lanes_of(documents, first, most_lanes)
    if laid is None:
        return total
    inputs, targets, owners, carried = laid
    longest, lanes = inputs.shape
    state, small = np.zeros((lanes, HIDDEN), np.float32), has_small_logits(weights)
    parts = _parted(weights)
    fresh = (carried == 0).any(axis=1)
    for start in range(0, longest, window):
        part = slice(start, min(start + window, longest))
        states = np.empty((part.stop - start, lanes, HIDDEN), np.float32)
        for t in range(start, part.stop):
            if fresh[t]:
                state = state * carried[t][:, None]
            states[t - start] = state = _follow(parts, inputs[t], state)
        real = owners[part].ravel() >= 0
        flat_states, goals = states.reshape(-1, HIDDEN), targets[part].ravel()
        if not real.all():
            flat_states, goals = flat_states[real], goals[real]
        logs = log_probabilities(weights, flat_states, goals, small)
        total += np.bincount(owners[part].ravel()[real], weights=logs, minlength=len(documents))
    return total


class Vocabulary(NamedTuple):
    """Words with their counts, most frequent first, and counts of the rare classes; bounded in size."""

    index: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: np.ndarray
    rare_distinct: np.ndarray
    ids: np.ndarray  # the network's id of each held word
