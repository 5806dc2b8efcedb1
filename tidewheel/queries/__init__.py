"""The registered queries over the events table, each with the SQL that gives the same rows."""

from . import series, streams

QUERIES = {**series.QUERIES, **streams.QUERIES}
ORACLES = {**series.ORACLES, **streams.ORACLES}
