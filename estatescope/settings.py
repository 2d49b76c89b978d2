"""Thresholds of the assessment, with the values used when none are given."""

# The defaults of the assessment.
MIN_RUNTIME_VERSION = "11.3"
DISALLOWED_ACCESS_MODES = ("NO_ISOLATION", "LEGACY_SINGLE_USER")
SUBMIT_RUN_LOOKBACK_DAYS = 30
