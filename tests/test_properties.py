"""Results do not depend on how the input is partitioned or ordered."""
import dataclasses

from castwork.operators import anomalies, bridges, jobs
from castwork.sources.binding import AS_OF
from castwork.sources.tables import TABLE_NAMES


def _shuffled(t, n):
    return dataclasses.replace(t, **{name: getattr(t, name).repartition(n).sortWithinPartitions(
        getattr(t, name).columns[-1]) for name in TABLE_NAMES})


def test_repartitioned_inputs_give_same_results(bound):
    other = _shuffled(bound, 5)
    for fn in (lambda t: jobs.at_risk_jobs(t, as_of=AS_OF), bridges.match_pct, bridges.job_heat,
               lambda t: anomalies.findings(t, as_of=AS_OF)):
        assert sorted(map(str, fn(bound).collect())) == sorted(map(str, fn(other).collect()))


def test_layout_sensitive_operators_are_partition_invariant(bound):
    from castwork.operators import cross, metering, schedule, scrap
    other = _shuffled(bound, 7)
    for fn in (cross.machine_signal, metering.daily_admission, metering.monthly_budget,
               lambda t: scrap.scrap_trend(t, as_of=AS_OF),
               lambda t: schedule.dispatch_week(t, as_of=AS_OF)):
        assert sorted(map(str, fn(bound).collect())) == sorted(map(str, fn(other).collect()))
