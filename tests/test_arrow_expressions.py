"""Arrow expressions as predicates keep the rows that Arrow keeps."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.operators.extract import extract
from quadrille.plans.arrow import from_arrow
from quadrille.plans.predicate import compiled
from quadrille.sources import cache

f = pc.field
N = 400


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same rows as an Arrow table and a DataFrame: null and NaN in every column that can have them."""
    rng = np.random.default_rng(4)
    some = lambda values, share=0.2: [None if rng.random() < share else v for v in values]
    numbers = lambda: [math.nan if rng.random() < 0.2 else float(rng.integers(-3, 4)) / 2 for _ in range(N)]
    table = pa.table(
        {
            "id": pa.array(range(N)),
            "a": pa.array(some(rng.integers(-3, 4, N).tolist()), pa.int64()),
            "x": pa.array(some(numbers()), pa.float64()),
            "y": pa.array(some(numbers()), pa.float32()),
            "s": pa.array(some(rng.choice(["ab", "b", "Ab", "", "c'd", 'q"e'], N).tolist())),
            "b": pa.array(some((rng.random(N) < 0.5).tolist())),
            "bbox": pa.array(some([{"xmin": v, "n.m": int(k)} for v, k in zip(numbers(), rng.integers(0, 3, N), strict=True)]), pa.struct([("xmin", pa.float64()), ("n.m", pa.int32())])),
        }
    )
    path = str(tmp_path_factory.mktemp("arrow") / "t.parquet")
    pq.write_table(table, path)
    return table, spark.read.parquet(path)


def check(both, expression):
    table, df = both
    kept = sorted(table.filter(expression)["id"].to_pylist())
    assert sorted(r.id for r in df.where(from_arrow(expression, df.schema)).select("id").collect()) == kept


FIXED = [
    f("a") > 0, f("x") >= 0.5, f("x") != 0.5, f("x") == float("nan"), ~(f("x") > 0.5), ~(f("x") != 0.0), f("y") < 0.5, f("x") > f("y"), ~(f("x") == f("y")),
    f("s") == "ab", f("s") != "c'd", f("s").isin(["b", 'q"e']), f("s").isin(["b", None]), ~f("s").isin(["b", None]), f("a").isin([1, 2]), f("x").isin([0.5, float("nan")]),
    pc.is_in(f("s"), value_set=pa.array(["b", None]), skip_nulls=True), f("s").is_null(), f("s").is_valid(), f("x").is_null(nan_is_null=True), f("x").is_nan(), ~f("x").is_nan(), f("a").is_nan(),
    f("b"), ~f("b"), f("b") & (f("a") > 0), f("b") | f("x").is_nan(), f("a") + 1 > 2, f("a") * 2 - f("x") < 1.0, f("a").cast("float64") > 0.5, -f("a") > 1 if hasattr(f("a"), "__neg__") else pc.negate(f("a")) > 1,
    f("bbox", "xmin") > 0.0, f("bbox", "n.m") == 1, f("bbox").is_null(), pc.starts_with(f("s"), "a"), pc.starts_with(f("s"), "a", ignore_case=True), pc.ends_with(f("s"), "b"), pc.match_substring(f("s"), "b"),
    pc.utf8_lower(f("s")) == "ab", pc.utf8_length(f("s")) > 1, pc.if_else(f("b"), f("a") > 0, f("x") > 0), pc.coalesce(f("a"), pc.scalar(3)) == 3, pc.scalar(True), pc.scalar(None, ) if False else f("a") == pa.scalar(2, pa.int32()),
]


@pytest.mark.parametrize("k", range(len(FIXED)))
def test_expressions(both, k):
    check(both, FIXED[k])


def _number() -> st.SearchStrategy:
    leaf = st.one_of(st.sampled_from([f("a"), f("x"), f("y"), f("bbox", "xmin")]), st.sampled_from([-1.0, 0.0, 0.5, 1.0, float("nan")]).map(pc.scalar), st.integers(-2, 2).map(pc.scalar))
    return st.recursive(leaf, lambda n: st.tuples(n, n, st.sampled_from("+-*")).map(lambda t: {"+": t[0] + t[1], "-": t[0] - t[1], "*": t[0] * t[1]}[t[2]]), max_leaves=3)


def _truth() -> st.SearchStrategy:
    order = st.tuples(_number(), _number(), st.sampled_from(["<", "<=", ">", ">=", "==", "!="])).map(lambda t: {"<": t[0] < t[1], "<=": t[0] <= t[1], ">": t[0] > t[1], ">=": t[0] >= t[1], "==": t[0] == t[1], "!=": t[0] != t[1]}[t[2]])
    other = st.sampled_from([f("b"), f("s") == "ab", f("s").isin(["b", None]), f("s").is_null(), f("x").is_nan(), f("x").is_null(nan_is_null=True), pc.match_substring(f("s"), "b")])
    return st.recursive(st.one_of(order, other), lambda t: st.one_of(t.map(lambda x: ~x), st.tuples(t, t).map(lambda p: p[0] & p[1]), st.tuples(t, t).map(lambda p: p[0] | p[1])), max_leaves=5)


@settings(max_examples=60, suppress_health_check=list(HealthCheck))
@given(expression=_truth())
def test_random_expressions(both, expression):
    check(both, expression)


def test_as_a_predicate(both):
    _, df = both
    expression = (f("s") == "ab") & (f("a") > 0)
    assert extract(df.withColumnRenamed("x", "geometry"), where=expression, columns=["s"]).columns == ["id", "geometry", "s"]
    assert compiled(expression, df.schema) is not None
    with pytest.raises(ValueError, match="no field nothing"):
        compiled(f("nothing") > 1, df.schema)
    with pytest.raises(ValueError, match="no counterpart"):
        compiled(pc.sqrt(f("x")) > 1, df.schema)


def test_result_names_tell_long_lists_apart():
    one, other = ([f"v{i}" for i in range(40)] for _ in range(2))
    other[20] = "w"
    assert str(f("s").isin(one)) == str(f("s").isin(other))
    assert cache._filter(f("s").isin(one)) != cache._filter(f("s").isin(other))
