"""The training step's arithmetic against a plain restatement, bit for bit, and the room it takes."""

import tracemalloc

import numpy as np

from turnera.llm import recurrent
from turnera.llm.recurrent import CLASSES, FREQUENT, HIDDEN, MEMBERS, RARE


def piece(random, steps=16, lanes=64):
    inputs, targets = random.integers(0, FREQUENT + RARE, (2, steps, lanes))
    carried = (random.random((steps, lanes)) > 0.05).astype(np.float32)
    return inputs.astype(np.int32), targets.astype(np.int32), random.random((steps, lanes)) > 0.1, carried, np.zeros((lanes, HIDDEN), np.float32)


def trainer(random):
    weights = recurrent.initial(np.arange(FREQUENT, 0, -1), np.ones(RARE))
    for name in ("class_w", "word_w"):
        weights[name] = random.normal(0, 0.2, weights[name].shape).astype(np.float32)
    return recurrent.Trainer(weights)


def restated(w, inputs, targets, carried, state):
    """Softmax errors of the classes, one step and one row of weights after the other."""
    states = []
    for row, stays in zip(inputs, carried):
        state = state * stays[:, None]
        state, _ = recurrent._advance(w, w["inputs"][row], state)
        states.append(state)
    flat, ids = np.concatenate(states), targets.ravel()
    logs = []
    for s, i in zip(flat, ids):
        logits = s @ w["class_w"] + w["class_b"]
        log = logits[i // MEMBERS if i < FREQUENT else i - FREQUENT + CLASSES] - np.log(np.exp(logits).sum())
        if i < FREQUENT:
            members = s @ w["word_w"][i // MEMBERS] + w["word_b"][i // MEMBERS]
            log += members[i % MEMBERS] - np.log(np.exp(members).sum())
        logs.append(log)
    return state, flat, np.array(logs)


def test_states_and_probabilities():
    random = np.random.default_rng(1)
    own = trainer(random)
    before = {n: w.copy() for n, w in own.weights.items()}
    given = piece(random, 5, 7)
    state, flat, logs = restated(before, given[0], given[1], given[3], given[4])
    assert np.array_equal(own._piece(*given), state)
    assert np.allclose(recurrent.log_probabilities(before, flat, given[1].ravel()), logs, atol=1e-5)


def test_a_state_that_is_carried_outlives_the_next_piece():
    random = np.random.default_rng(2)
    own, given = trainer(random), piece(random)
    state = own._piece(*given)
    kept = state.copy()
    own._piece(*given[:4], state)
    assert np.array_equal(state, kept)


def test_pieces_use_their_room_again():
    """A piece takes little more than the weights' own gradients; its arrays are not made anew."""
    random = np.random.default_rng(3)
    own, given = trainer(random), piece(random, 16, 256)
    own._piece(*given)
    tracemalloc.start()
    own._piece(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11.5e6
