from corpusloom.operators.rng import CATEGORIES, Stream, filled, line_selection


def test_golden():
    s = Stream(1337, 7, 42)
    assert [s.next() for _ in range(3)] == [14422954827547773155, 8900491109341867659, 16519258455261250301]
    assert Stream(1337, 7, 42).below(1000) == 781
    assert Stream(7, 10, 3).between(10, 20) == 14
    assert CATEGORIES["DirTree"] == 1 and CATEGORIES["Placement"] == 10 and CATEGORIES["Firmware"] == 24


def test_draws():
    items = list(range(50))
    assert sorted(Stream(1, 2, 3).shuffled(items)) == items == items and Stream(1, 2, 3).shuffled(items) == Stream(1, 2, 3).shuffled(items)
    assert all(50 <= Stream(1, 2, i).size(100, 1000, 5000) < 5000 for i in range(200))
    assert {Stream(1, 2, i).pick([1, 3, 6]) for i in range(200)} == {0, 1, 2}
    assert sum(line_selection(10_000, 0.1, 1, 0)) in range(850, 1150)
    assert filled([1, 2, 3, 4], 2, lambda x: x % 2 == 0) == [2, 4]
