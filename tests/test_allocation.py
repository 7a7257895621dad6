import itertools

from pyspark.sql import functions as F

from slicewise.operators import allocation as AL
from slicewise.plans import registry as R


def test_candidates_t17(spark):
    c = AL.candidates(spark, 17).orderBy("cand_id").collect()
    assert len(c) == 120
    assert [(r.rbg_0, r.rbg_1, r.rbg_2) for r in c] == AL.candidate_list(17)
    assert [r.cand_id for r in c] == list(range(120))


def test_golden_linear_t5(spark):
    st = spark.createDataFrame([("s1",)], "state_id string")
    out = AL.custom_search(st, AL.linear_scorer(0.2, 0.5, 0.3), total=5).first()
    assert (out.best_rbg_0, out.best_rbg_1, out.best_rbg_2) == (1, 3, 1)
    assert abs(out.best_score - 2.0) < 1e-12


def test_no_candidate_falls_back_to_current(spark):
    st = spark.createDataFrame([("s1",)], "state_id string")
    out = AL.custom_search(st, AL.linear_scorer(1.0, 1.0, 1.0), total=2).first()
    assert (out.best_rbg_0, out.best_rbg_1, out.best_rbg_2, out.best_score) == (5, 7, 5, 0.0)


def _heur(req, qos, load, r):
    prb = min(1.0, (req if req is not None else 1) / max(1, r))
    return max(0.0, min(1.0, (0.4 * prb + 0.4 * qos) + 0.2 * (1.0 - load)))


def test_exhaustive_matches_brute_force(spark, sf):
    from conftest import unique_by
    st = unique_by(R.states(spark, sf), "state_id")
    got = {r.state_id: r for r in AL.exhaustive_search(st).collect()}
    rows = st.select("state_id", "sum_requested_prbs", "qos_score", "network_load").collect()
    assert len(got) == len(rows)
    for row in rows[:400]:
        best, arg = -1.0, None
        for a, b, c in AL.candidate_list(17):
            s = ((_heur(row.sum_requested_prbs, row.qos_score, row.network_load, a)
                  + _heur(row.sum_requested_prbs, row.qos_score, row.network_load, b))
                 + _heur(row.sum_requested_prbs, row.qos_score, row.network_load, c)) / 3.0
            if s > best:
                best, arg = s, (a, b, c)
        g = got[row.state_id]
        assert (g.best_rbg_0, g.best_rbg_1, g.best_rbg_2) == arg
        assert g.best_score == best
        assert g.improvement >= 0


def test_validate_and_summary(spark, sf):
    res = R.exhaustive(spark, sf)
    v = AL.validate_allocations(res).first()
    assert v.valid and v.n_invalid == 0
    s = {r.scenario: r for r in AL.improvement_summary(res).collect()}
    assert s[None].steps == res.count()
    assert sum(r.steps for k, r in s.items() if k is not None) == s[None].steps


def test_candidate_features_long_form(spark, sf):
    st = R.states(spark, sf).limit(5)
    x = AL.candidate_features(st.select("state_id", "sum_requested_prbs"))
    assert x.count() == 5 * 120 * 3
    assert x.agg(F.max("prb_utilization")).first()[0] <= 1.0


def test_assert_valid_guard(spark, sf):
    import pytest
    res = R.exhaustive(spark, sf)
    assert AL.assert_valid(res).count() == res.count()
    bad = res.withColumn("best_rbg_2", F.col("best_rbg_2") + 1)
    with pytest.raises(Exception, match="does not sum"):
        AL.assert_valid(bad).collect()
