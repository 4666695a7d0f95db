import pytest

from diffloom.functions.names import bare, chunks, quoted, safe_suffix, table_name
from diffloom.sources.tables import column_groups
from diffloom.spec import CompareSpec

BASE = {"left": "a", "right": "b", "keys": ("id", "day"), "batch": "day", "critical": ("x",)}


@pytest.mark.parametrize(
    "wrong",
    [
        {"left": ""},
        {"right": " "},
        {"keys": ()},
        {"batch": "other"},
        {"critical": ()},
        {"critical": ("id",)},
        {"left_label": "same", "right_label": "same"},
        {"left_label": "diff"},
        {"right_label": "id"},
        {"group_size": 0},
        {"columns_per_pass": 0},
        {"sample_per_column": 0},
        {"detail": "everything"},
        {"noisy_threshold": 0},
        {"noisy_threshold": 1.5},
        {"default_tolerance": -1},
        {"tolerances": {"x": -0.1}},
        {"database": ""},
    ],
)
def test_rejected(wrong):
    with pytest.raises(ValueError):
        CompareSpec(**(BASE | wrong))


def test_run_ids_are_distinct_and_blank_ones_replaced():
    ids = {CompareSpec(**BASE, run_id=r).run_id for r in (None, "", "  ", None)}
    assert len(ids) == 4
    assert CompareSpec(**BASE, run_id="mine").run_id == "mine"


def test_defaults_and_changes():
    spec = CompareSpec(**BASE)
    assert (spec.group_size, spec.sample_per_column, spec.detail, spec.noisy_threshold) == (100, 10, "sample", 0.95)
    assert spec.using(detail="full").detail == "full"


def test_names():
    assert bare("`a`") == "a" and bare('"b c"') == "b c" and bare("'") == "'"
    assert quoted("a`b") == "`a``b`"
    assert safe_suffix("run 2024-01/é") == "run_2024_01" and safe_suffix("--") == "run"
    assert table_name("db", "diff", "x") == "`db`.`diff_x`"
    assert chunks([1, 2, 3], 2) == [[1, 2], [3]]
    with pytest.raises(ValueError):
        chunks([1], 0)


def test_groups_put_critical_columns_first():
    assert column_groups(["a", "b", "c", "d"], ["d", "zz", "b", "d"], 3) == [["d", "b", "a"], ["c"]]
