"""Feature tables and predictions several queries start from."""

from __future__ import annotations

from gaugeline.operators import features as feat
from gaugeline.operators import schedule
from gaugeline.operators.schedule import Regimen
from gaugeline.plans import backtest
from gaugeline.queries.registry import events

ENTITY, TS, TARGET = "event_type", "ts", "value"
WEEK = Regimen("7D", "1D", min_train=300)
PER_ENTITY = Regimen("7D", "1D", min_train=160)


def feature_table(spark, d, names=("weekday", "hour", "hist_1D"), step="1h", **kw):
    return feat.transform(events(spark, d), ENTITY, TS, TARGET, list(names), step, **kw)


def span(spark, d):
    return schedule.measured_range(events(spark, d), TS)


def naive_predictions(spark, d):
    return backtest.naive(feature_table(spark, d), span(spark, d), WEEK, ENTITY, TS, TARGET)
