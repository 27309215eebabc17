"""Versioned zone transition tables and vectorised conversion from local clocks to UTC."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache
from importlib import metadata

import numpy as np

#: First and last year the tables cover.
FIRST_YEAR, LAST_YEAR = 1970, 2100


def table_version() -> str:
    """The release of the zone data that the tables are built from."""
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "system"


class ZoneTable:
    """UTC seconds of each transition and the offset that holds from it on."""

    def __init__(self, zone: str) -> None:
        tz, utc = zoneinfo.ZoneInfo(zone), dt.timezone.utc
        offset = lambda s: int((dt.datetime(1970, 1, 1, tzinfo=utc) + dt.timedelta(seconds=s)).astimezone(tz).utcoffset().total_seconds())
        end = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=utc).timestamp())
        at, offsets, s, now = [-(1 << 62)], [offset(0)], 0, offset(0)
        while s < end:
            if (then := offset(s + 86400)) != now:
                lo, hi = s, s + 86400
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
                at.append(hi)
                offsets.append(offset(hi))
                now = then
            s += 86400
        self.version = table_version()
        self.at, self.offsets = np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)

    def to_utc_ms(self, local_ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC ms and whether the local time occurs exactly once; a time in a gap or an overlap does not."""
        utc, hits = np.zeros_like(local_ms), np.zeros(len(local_ms), dtype=np.int64)
        for off in np.unique(self.offsets):
            u = local_ms - off * 1000
            ok = self.offsets[np.searchsorted(self.at, u // 1000, "right") - 1] == off
            utc, hits = np.where(ok, u, utc), hits + ok
        return utc, hits == 1


@lru_cache(maxsize=None)
def zone_table(zone: str) -> ZoneTable | None:
    """The table of a zone, built once per worker; None for a name that isn't a zone."""
    try:
        return ZoneTable(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
