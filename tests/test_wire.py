import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.sources import wire

simple = st.text(alphabet=st.characters(blacklist_characters="\r\n", blacklist_categories=("Cs",)))
values = st.recursive(st.one_of(st.none(), st.binary(), st.integers(), simple, simple.map(wire.Failure)), lambda x: st.lists(x, max_size=4), max_leaves=8)


@given(values)
def test_values_round_trip_and_prefixes_are_incomplete(value):
    data = wire.encode(value)
    assert wire.decode(data) == (value, len(data))
    for cut in {0, 1, len(data) // 2, len(data) - 1}:
        with pytest.raises(wire.Incomplete):
            wire.decode(data[:cut])


def test_integers_near_powers_of_ten():
    for k in range(20):
        for n in (10**k - 1, 10**k, 10**k + 1):
            assert wire.decode(wire.encode(n))[0] == n and wire.decode(wire.encode(-n))[0] == -n


def test_malformed_values():
    for bad in (b"?\r\n", b":x\r\n", b"$-2\r\n", b"$1\r\nab\r\n", b"*x\r\n"):
        with pytest.raises(wire.Malformed):
            wire.decode(bad)


def test_captured_requests(spark, tmp_path):
    one = wire.encode([b"ENQUEUE", b"q", b"a value", b"DELAY", b"10"])
    (tmp_path / "a").write_bytes(one + wire.encode([b"peek", b"q"]) + one[:9])
    (tmp_path / "b").write_bytes(wire.encode([1]))
    got = sorted(wire.read_requests(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.place))
    assert [(r.op, r.value, r.deadline_arg_ms) for r in got[:2]] == [("ENQUEUE", "a value", 10), ("PEEK", None, None)]
    assert [r.damage for r in got] == [None, None, "incomplete", "a request is an array of strings"]
