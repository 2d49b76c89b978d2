from estatescope.sinks.report import REPORT_TABLES, write_report
from estatescope.sinks.snapshots import SnapshotStore

__all__ = ["REPORT_TABLES", "SnapshotStore", "write_report"]
