"""Arrays of a batch are sketched in runs of bounded size."""

import numpy as np
import pyarrow as pa
import pytest

from sigweave.functions import hashing, kernels
from sigweave.spec import FNV, Spec


@pytest.mark.parametrize("rows", [[], [None], [["a"] * 9 + ["b"], [], None, ["c", None], ["a"], ["b", "a"] * 3, []], [[str(i)] * (i % 4) for i in range(50)]])
def test_runs(rows, monkeypatch):
    seen, digest = [], kernels.digest
    monkeypatch.setattr(kernels, "digest", lambda c, h: seen.append(len(c)) or digest(c, h))
    f = hashing.sketch_array_udf(Spec(8, "u64", FNV))
    f = getattr(f, "func", f)
    column = pa.array(rows, pa.list_(pa.string()))
    whole = f(column)
    seen.clear()
    monkeypatch.setattr(hashing, "ELEMENTS", 4)
    assert f(column).to_pylist() == whole.to_pylist()
    assert all(n <= max([4, *(len(r or []) for r in rows)]) for n in seen) and sum(seen) == sum(len(r or []) for r in rows)
    for r, w in zip(rows, whole.to_pylist(), strict=True):
        d = digest(pa.array([v for v in r or [] if v is not None], pa.string()), FNV)[0]
        assert w == (None if r is None else np.min([*kernels.stream(np.r_[d], Spec(8, "u64", FNV))], axis=1).view(np.int64).tolist() if len(d) else [-1] * 8)
