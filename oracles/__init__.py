"""Independent SQL for the registered queries, in DuckDB's dialect."""

from . import core, logs, reports

ORACLES: dict[str, str] = {**core.ORACLES, **logs.ORACLES, **reports.ORACLES}
