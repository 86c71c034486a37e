"""Named queries over the given tables, each with the SQL that must return the same rows where SQL can."""

from gaugeline.queries import cleaning, files, learning, schedules, series, streams, texts, viewing  # noqa: F401
from gaugeline.queries.registry import ORACLE, QUERIES  # noqa: F401
