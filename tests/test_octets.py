"""What the byte functions hold in Python: Arrow arrays, not lists of Python objects."""

import tracemalloc

import pyarrow as pa

from siltstone.functions import octets as O


def peak(f, data):
    tracemalloc.start()
    try:
        return f(data), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_byte_functions_of_a_batch_stay_small():
    data = pa.array([bytes(range(256)) * 8] * 2000 + [b"", None, b"aab"], pa.binary())
    shares, most = peak(O.byte_frequency.func, data)
    assert most < 2 * len(data) * 256 * 8
    assert shares[0].as_py() == [1 / 256] * 256 and shares[2000].as_py() == shares[2001].as_py() == [0.0] * 256 and shares[2002].as_py()[97] == 2 / 3
    bits, most = peak(O.entropy.func, data)
    assert most < 1 << 20 and [x.as_py() for x in bits[1999:2002]] == [8.0, 0.0, 0.0]
