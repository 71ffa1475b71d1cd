"""The fold's building blocks, checked without Spark."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.operators.fold import Trajectories, _masks, compose


def walk_from(state, rows, k):
    """Matches made by a run of entries (rows of 0/1 step flags) entered in ``state``."""
    m = 0
    for row in rows:
        if row[(state + m) % k]:
            m += 1
    return m


runs = st.integers(1, 9).flatmap(
    lambda k: st.tuples(st.just(k), st.lists(st.lists(st.booleans(), min_size=k, max_size=k), max_size=60))
)


def followed(rows, k, cuts=()):
    """The summary of a run whose masks come in batches, cut at ``cuts``."""
    masks = [sum(1 << s for s in range(k) if row[s]) for row in rows]
    walker = Trajectories(range(k))
    for a, b in zip([0, *cuts], [*cuts, len(masks)]):
        walker.feed(masks[a:b])
    return walker.advances()


@settings(max_examples=300, deadline=None)
@given(runs, st.data())
def test_trajectories_are_the_walk_from_every_state(case, data):
    k, rows = case
    cut = data.draw(st.integers(0, len(rows)))
    assert followed(rows, k, [cut]) == [walk_from(s, rows, k) for s in range(k)]
    walker = Trajectories(range(k), [0])
    walker.feed([sum(1 << s for s in range(k) if row[s]) for row in rows])
    assert walker.advances() == [walk_from(0, rows, k)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.lists(st.integers(1, 7), max_size=60))
def test_steps_that_share_a_predicate(bits, masks):
    walker = Trajectories(bits)
    walker.feed(masks)
    rows = [[mask >> b & 1 for b in bits] for mask in masks]
    assert walker.advances() == [walk_from(s, rows, len(bits)) for s in range(len(bits))]


@settings(max_examples=300, deadline=None)
@given(runs, st.data())
def test_compose_is_associative_and_splits_anywhere(case, data):
    k, rows = case
    cut1 = data.draw(st.integers(0, len(rows)))
    cut2 = data.draw(st.integers(cut1, len(rows)))
    a, b, c = (np.array(followed(x, k), dtype=np.int64) for x in (rows[:cut1], rows[cut1:cut2], rows[cut2:]))
    left = compose(compose(a, b, k), c, k)
    right = compose(a, compose(b, c, k), k)
    assert left.tolist() == right.tolist() == followed(rows, k)


@given(st.integers(1, 100), st.data())
def test_masks_are_read_from_63_bits_per_word(k, data):
    flags = data.draw(st.lists(st.booleans(), min_size=k, max_size=k))
    words = [sum(1 << (i - w) for i in range(w, min(k, w + 63)) if flags[i]) for w in range(0, k, 63)]
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in words], names=[f"m{i}" for i in range(len(words))])
    assert _masks(batch, batch.schema.names) == [sum(1 << i for i in range(k) if flags[i])]


def test_work_follows_the_matches_not_the_steps():
    """With 100 steps of three predicates, a long run of one entry each moves few trajectories."""
    walker = Trajectories([i % 3 for i in range(99)])
    walker.feed([1 << (i % 3) for i in range(3)] * 2)
    before = sum(walker.made.values())
    walker.feed([1] * 10_000)
    assert len(walker.at) <= 33 and sum(walker.made.values()) - before <= 99
