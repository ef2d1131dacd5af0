"""Interval join and what rests on it, with encounters of years: few rows a stay, one look a query, the same results as brute force."""

import datetime as dt
import random

import pytest

from riskloom.operators import cohort, outcomes, sensitivity
from riskloom.plans import queries

DAY = dt.datetime(1995, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    day = lambda: DAY + dt.timedelta(days=rng.randint(0, 2400), hours=rng.choice([0, 0, 7]))
    records = [(rng.randint(1, 12), k, day()) for k in range(150)] + [(1, 150, None), (None, 151, DAY)]
    stays = []
    for k in range(120):
        start, died = day(), rng.choice([0, 1, 1, None])
        end = start + dt.timedelta(days=rng.choice([0, 3, 29, 119, 121, 700, 1344, 1921, 2497, 40000]))
        stays.append((rng.randint(1, 12), k, start, end, died, rng.choice([None, end, start])))
    stays += [(1, 200, DAY, None, 1, None), (2, 201, DAY + dt.timedelta(days=9), DAY, 1, None)]
    # encounters that start together: the smaller id counts; one holds the other
    stays += [(3, 202, DAY, DAY + dt.timedelta(days=50), 0, None), (3, 203, DAY, DAY + dt.timedelta(days=3000), 1, None)]
    r = spark.createDataFrame(records, "subject_id long, study_id long, ecg_datetime timestamp_ntz")
    a = spark.createDataFrame(stays, "subject_id long, hadm_id long, admit_dt timestamp_ntz, disch_dt timestamp_ntz, hospital_expire_flag long, death_dt timestamp_ntz")
    return records, stays, r, a


def inside(records, stays, hours=0):
    return [(r, s) for r in records for s in stays if r[0] is not None and r[0] == s[0] and r[2] and s[3] and s[2] - dt.timedelta(hours=hours) <= min(r[2], s[3]) and r[2] <= s[3]]


def test_long_encounters_take_few_rows_in_the_join(tables):
    records, stays, r, a = tables
    rows = cohort.spanned_encounters(a).groupBy("hadm_id").count().collect()
    assert len(rows) == sum(1 for s in stays if s[3] and s[2] <= s[3])
    # 40,000 days would be 1,334 spans of 30 days; they are 6 or 7 of the widest
    assert max(x["count"] for x in rows) <= 7
    for hours in (0, 24):
        got = sorted((x.study_id, x.hadm_id) for x in cohort.link_admissions(r, a, hours).collect())
        assert got == sorted((x[1], s[1]) for x, s in inside(records, stays, hours))


@pytest.mark.parametrize("hours", [0, 24])
def test_first_encounter_among_long_ones(tables, hours):
    records, stays, r, a = tables
    want = {x[1]: (None, None) for x in records}
    for x, s in sorted(inside(records, stays, hours), key=lambda p: (p[1][2], p[1][1]), reverse=True):
        want[x[1]] = (s[4] == 1 and (s[5] is None or x[2] <= s[5]), s[1])
    assert len({v[1] for v in want.values()}) > 20
    got = outcomes.inhospital_mortality(r, a, hours).collect()
    assert len(got) == len(records) and {x.study_id: (x.in_hospital_mortality, x.linked_hadm_id) for x in got} == want
    # no pair is sorted: what leaves the join is a row a recording and width at most
    assert outcomes.first_encounters(r, a, hours).count() == sum(1 for v in want.values() if v[1] is not None)


def test_labels_in_hospital_join_once(spark, tables):
    records, stays, r, a = tables
    p = spark.createDataFrame([(k, k) for k in range(1, 14)], "subject_id long, x long")
    got = sensitivity.with_inhospital(p, r, a)
    assert "_span" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {k: None for k in range(1, 14)}
    for k in want:
        mine = sorted((x for x in records if x[0] == k), key=lambda x: (x[2] or dt.datetime.min, x[1]))[:1]
        for x, s in sorted(inside(mine, stays), key=lambda q: (q[1][2], q[1][1]))[:1]:
            want[k] = s[4] == 1 and (s[5] is None or x[2] <= s[5])
    assert len(set(want.values())) == 3 and {x.subject_id: x.inhospital_mortality for x in got.collect()} == want


def test_index_cohorts_join_once(spark, tables):
    records, stays, r, a = tables
    p = spark.createDataFrame([(k, k) for k in range(1, 14)], "subject_id long, x long")
    got = sensitivity.index_cohorts(p, r, a)
    assert "_span" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for name, rows in (("earliest", [x for x in records if x[0] is not None]), ("admission", [x for x, _ in inside(records, stays)])):
        for x in sorted(rows, key=lambda x: (x[2] or dt.datetime.min, x[1]), reverse=True):
            want[x[0], name] = x[1]
    assert {(x.subject_id, x.cohort): x.index_study_id for x in got.collect()} == want and got.count() == len(want)


def test_anchoring_sensitivity_joins_once(spark):
    got = queries.anchoring_sensitivity(spark, "/root/testdata/sf0.001")
    assert "_span" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 3


def test_outcome_statistics_reads_each_table_few_times(spark):
    """Once for the death table and once for the first encounters; before, the outcomes with all they read stood three times in the plan."""
    plan = queries.outcome_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_shipdate" in line for line in plan.splitlines()) == 2
