"""Explicit report parameters; nothing in the library reads the clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

UTC = dt.timezone.utc


@dataclass(frozen=True)
class Params:
    as_of: dt.datetime
    # First day of the operational window and the CVE year that belongs to it.
    op_min_date: dt.datetime = dt.datetime(2026, 1, 1, tzinfo=UTC)
    op_year: str = "2026"
    # Forces the observed start of operation; otherwise it is read from the mirror.
    op_start: dt.datetime | None = None
    # Fixed value: sources that loaded whole archives on their first run.
    archive_sources: tuple[str, ...] = field(
        default=("github_advisories", "osv", "gemnasium"))
    # Dates below this are zero dates, not history.
    min_valid_date: dt.datetime = dt.datetime(1990, 1, 1, tzinfo=UTC)
    max_lead_days: int = 3650
