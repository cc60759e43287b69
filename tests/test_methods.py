"""The cost methods on histories small enough to count by hand."""

from ledgerloom.operators.folds import METHODS, ONE


def run(method, *events):
    state = METHODS[method]()
    return [state.step(kind, units * ONE, value * ONE, 0) for kind, units, value in events]


def test_unrounded_average():
    (*_, (last, review)) = run("unrounded", ("acquire", 10, 50), ("acquire", 10, 150), ("dispose", 10, 200))
    assert last == [10 * ONE, 100 * ONE, 10 * ONE, 100 * ONE, 100 * ONE] and not review
    (_, (below, over), (after, again)) = run("unrounded", ("acquire", 10, 50), ("dispose", 15, 90), ("dispose", 1, 9))
    assert below[:2] == [-5 * ONE, -25 * ONE] and over  # no clamp
    assert after[:2] == below[:2] and after[3:] == [0, 0] and again  # nothing goes from an empty pool


def test_cost_in_cents():
    (*_, (last, review)) = run("cents", ("acquire", 3, 10), ("dispose", 1, 5))
    assert last[3] == 333 * ONE // 100 and last[1] == 667 * ONE // 100 and not review


def test_principal():
    got = [x[0][::4] for x in run("principal", ("acquire", 10, 0), ("dispose", 4, 0), ("dispose", 8, 0), ("dispose", 3, 0), ("acquire", 5, 0), ("out", 0, 0))]
    assert got == [[10 * ONE, 0], [6 * ONE, 0], [0, 2 * ONE], [0, 0], [5 * ONE, 0], [0, 0]]
