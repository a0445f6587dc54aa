"""Steps that are made once, and parts that grow with the rows: what keeps queries within their limits on large tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from barlattice.operators import execution as ex
from barlattice.operators import fronts
from barlattice.operators import identity as idn
from barlattice.operators import statistics as stt
from barlattice.operators import structure as st
from barlattice.plans import q_execution, q_joins, q_ledger, q_patterns, q_shortlist, q_statistics, q_structure
from barlattice.sources import panel as P

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def bars_read(monkeypatch):
    """How often the line items are made into bars."""
    calls, made = [], P.bars_of
    monkeypatch.setattr(P, "bars_of", lambda x: calls.append(1) or made(x))
    return calls


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("rows", [q_statistics.cohort_rows, q_joins.model_pairs])
def test_models_of_a_query_share_bars_and_path(spark, bars_read, rows):
    rows(spark, SMALL)
    assert len(bars_read) == 1


def test_replay_makes_its_path_once(spark):
    path = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.5, 1.5, 1.2, 0.1, 9.0)], "signal_id string, step long, b_open double, b_high double, b_low double, b_close double, trigger double, stop double, target double")
    assert "Join" not in plan_of(ex.replay(path))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_structures_judge_each_low_once(spark):
    """Without the arrays of whole bars, of which pairs were made; the simulation finds its structures once."""
    assert "AS past#" not in plan_of(q_structure.pullback_structures(spark, SMALL))
    assert "lambda" not in plan_of(q_structure.structure_simulation(spark, SMALL))


def test_leaves_of_known_places_are_the_same(spark, monkeypatch):
    lines = spark.createDataFrame([(s, i, f"{s} {i}") for s, n in (("a", 9), ("b", 1)) for i in range(n)], "stream string, at long, line string").repartition(3)
    want = sorted(idn.leaves(lines, "stream", ["at"], "line", 4).collect())
    monkeypatch.setattr(idn, "group_places", None)
    assert sorted(idn.placed_leaves(lines, "stream", "at", "line", 4).collect()) == want


def test_few_groups_are_not_exchanged_again(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    x = stt.group_places(df, "k", [F.col("id")], "at")
    assert "Exchange hashpartitioning(k" not in x._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" in x._jdf.queryExecution().sparkPlan().toString()
    assert {(r.id, r["at"]) for r in x.collect()} == {(i, i // 3) for i in range(100)}


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(stt, "RANGE", 10)
    r = random.Random(3)
    values = [r.randrange(50) * 1.0 for _ in range(101)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    assert stt.numbered_ranges(df, ["v"], 101).select("__range").distinct().count() > 4
    assert stt.exact_quantiles(df, ["k"], "v", [0.5], 101).first().quantiles == [sorted(values)[50]]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_dominators_share_bars_and_find_no_fronts(spark, bars_read, monkeypatch):
    monkeypatch.setattr(fronts, "fronts", None)
    q_shortlist.dominators(spark, SMALL)
    assert len(bars_read) == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_dominance_and_shortlist_make_levels_once(spark, monkeypatch):
    """No front is peeled for numbers of dominators, and the fronts of the shortlist read written levels."""
    monkeypatch.setattr(fronts, "fronts", None)
    q_joins.dominance(spark, SMALL)
    assert "vma20_prev" not in plan_of(q_ledger.shortlist(spark, SMALL))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_only_signals_take_bars_of_the_profile(spark):
    assert "AS past#" not in plan_of(q_patterns.score(spark, SMALL))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("states", [q_structure.exit_states, q_structure.exit_states_by_volume])
def test_exit_states_exchange_line_items_once(spark, monkeypatch, states):
    """The steps after a structure lie on its row: nothing is joined, and bars are made once, where the symbol is; a symbol with many line items has them made before."""
    found = {}
    for together, exchanges in ((P.TOGETHER, 1), (1, 2)):
        monkeypatch.setattr(P, "TOGETHER", together)
        x = states(spark, SMALL)
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == exchanges and plan.count("FileScan") == 1
        found[exchanges] = sorted(map(str, x.collect()))
    assert found[1] == found[2] and found[1]


def test_pushes_of_arrays_and_of_rows_are_the_same(spark):
    r = random.Random(5)
    price = lambda: r.choice([None, 9.0, 9.5, 10.0, 10.0, 10.5, 11.0])
    paths = {f"{i}": [[price() for _ in range(4)] for _ in range(r.randrange(11))] for i in range(200)}
    kind = "struct<open: double, high: double, low: double, close: double>"
    arrays = spark.createDataFrame([(k, 1, 10.5, 9.5, [tuple(b) for b in own]) for k, own in paths.items()], f"symbol string, date int, peak double, low1 double, after array<{kind}>")
    rows = spark.createDataFrame([(k, i + 1, own[0][0], 10.5, 9.5, *b) for k, own in paths.items() for i, b in enumerate(own)], "key string, step int, entry double, peak double, floor double, open double, high double, low double, close double")
    facts = ["step", "push", "exit_state", "exit_class", "exit_action"]
    got = st.with_exits(st.pushes_after(arrays)).select("symbol", "n", *facts).collect()
    want = st.exit_states(rows).select("key", "failed_pushes", *facts).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len({r.exit_state for r in got}) == 5
