"""Zone transition tables: of each zone the moments at which its offset changes, as sorted arrays.

A table belongs to one version of the public zone database; ``version()`` names it, so that results can be traced.
"""

from __future__ import annotations

import datetime as dt
import os
import zoneinfo
from dataclasses import dataclass
from functools import cache

import numpy as np

FIRST_YEAR, LAST_YEAR = 1900, 2101
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_WEEK = 7 * 86400


def version() -> str:
    """Version of the zone database in use."""
    try:
        import tzdata

        packaged = tzdata.IANA_VERSION
    except ImportError:
        packaged = "unknown"
    for root in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = os.path.join(root, name)
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    return f.readline().replace("# version", "").strip()
        if os.path.isdir(root):
            return "system"
    return packaged


@dataclass(frozen=True)
class ZoneTable:
    name: str
    begins: np.ndarray  # seconds since 1970 UTC from which the offset of the same index holds
    offsets: np.ndarray  # seconds east of UTC

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.maximum(np.searchsorted(self.begins, utc, side="right") - 1, 0)]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants of wall times, and of how many instants each is the wall time: 0 if skipped, 2 if repeated."""
        utc, n = np.zeros(len(wall), np.int64), np.zeros(len(wall), np.int8)
        for offset in np.unique(self.offsets):
            u = wall - offset
            right = self.offset_at(u) == offset
            utc = np.where(right, u, utc)
            n += right
        return utc, n


@cache
def table(name: str) -> ZoneTable | None:
    """The table of an IANA zone, or None if there is no such zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(t: int) -> int:
        return int((_EPOCH + dt.timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    at = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.UTC) - _EPOCH).total_seconds())
    end = int((dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.UTC) - _EPOCH).total_seconds())
    begins, offsets = [at], [offset(at)]
    while at < end:
        nxt = at + _WEEK
        if (o := offset(nxt)) != offsets[-1]:
            low, high = at, nxt
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            begins.append(high)
            offsets.append(offset(high))
            if offsets[-1] != o:  # two changes within a week: go on from the first
                nxt = high
        at = nxt
    return ZoneTable(name, np.array(begins, np.int64), np.array(offsets, np.int64))
