"""Random small tables against a comparison cell by cell in Python."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from diffloom.plans.compare import Comparison
from diffloom.spec import CompareSpec

VALUES = st.tuples(st.sampled_from([None, 0.0, 1.0, 1.4, 5.0]), st.sampled_from([None, "", "a", "b"]), st.sampled_from([None, 1, 2]))
TABLES = st.dictionaries(st.tuples(st.integers(1, 6), st.sampled_from("ab")), VALUES, max_size=9)
SCHEMA = "id long, day string, v double, s string, n long"


def brute(left, right, tolerance):
    summary, status = Counter(), Counter()
    for key in left.keys() | right.keys():
        kind = "matched" if key in left and key in right else "left_only" if key in left else "right_only"
        status[(key[1], kind)] += 1
        if kind == "matched":
            for name, a, b in zip("vsn", left[key], right[key], strict=True):
                odd = (a is None) != (b is None) or (a is not None and (abs(a - b) > tolerance if name == "v" else a != b))
                summary[(key[1], name)] += odd
    return summary, status


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(TABLES, TABLES, st.integers(1, 3), st.booleans())
def test_random_tables(spark, left, right, group_size, share):
    right = {**right, **{k: v for k, v in left.items() if share and k[0] % 2}}
    sides = [spark.createDataFrame([(*k, *v) for k, v in t.items()], SCHEMA) for t in (left, right)]
    with Comparison(spark, CompareSpec(*sides, ("id", "day"), "day", ("v",), tolerances={"v": 0.5}, group_size=group_size)) as c:
        summary, status = brute(left, right, 0.5)
        assert {(r["batch_key"], r["row_status"]): r["row_count"] for r in c.row_status_counts.collect()} == dict(status)
        assert {(r["batch_key"], r["column"]): r["mismatch_count"] for r in c.summary_by_batch.collect()} == dict(summary)
        assert c.mismatch_detail.count() == sum(summary.values())
