import datetime as dt
import decimal

import pytest

from rangeloom.bounds import KeyRange, from_json, to_json


def test_none_is_open_and_zero_is_a_bound():
    assert KeyRange.of(None, 0).meets((-3,), (-1,))
    assert not KeyRange.of(None, 0).meets((1,), (5,))
    assert KeyRange.of(-5, 0, default_is_unbounded=True) == KeyRange((-5,), None)
    assert KeyRange.of("", None, default_is_unbounded=True) == KeyRange()


@pytest.mark.parametrize(("start", "end", "empty"), [(7, 3, True), (3, 3, False), (None, 1, False), (3, 7, False)])
def test_inverted_is_empty(start, end, empty):
    assert KeyRange.of(start, end).empty is empty


def test_half_open_point_is_empty():
    assert KeyRange.of(3, 3, start_included=False).empty


def test_file_tests():
    r = KeyRange.of(10, 20)
    assert r.meets((0,), (10,)) and r.meets((20,), (30,)) and not r.meets((21,), (30,)) and not r.meets((0,), (9,))
    assert r.covers((10,), (20,)) and not r.covers((9,), (20,))
    assert not KeyRange.of(10, 20, end_included=False).meets((20,), (30,))


def test_composite_prefix():
    r = KeyRange.of((2,), (3,), width=2)
    assert r.meets((3, 9), (4, 0)) and r.covers((2, 0), (3, 7)) and not r.meets((4, 0), (5, 0))


def test_bad_bounds():
    with pytest.raises(ValueError):
        KeyRange.of((1, None), None, width=2)
    with pytest.raises(ValueError):
        KeyRange.of((1, 2, 3), None, width=2)


@pytest.mark.parametrize("key", [(0,), (-1, "é🌳"), (b"\x00\xff",), (dt.datetime(2024, 2, 3, 4, 5, 6, 7),), (dt.date(1999, 1, 2),), (decimal.Decimal("1.50"),), (True,)])
def test_keys_survive_json(key):
    assert from_json(to_json(key)) == key
