"""Store specifications and frequencies."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "t": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
DAY = _UNITS["d"]


class DuplicateChunkError(ValueError):
    """A plain write meets a chunk, or a timestamp, that is there already."""


def fix_frequency(freq: str) -> str:
    """``freq`` with a leading 1 where it has no number: ``h`` is ``1h``."""
    if not isinstance(freq, str) or not freq:
        raise ValueError(f"not a frequency: {freq!r}")
    return freq if freq[0].isdigit() else f"1{freq}"


def frequency_us(freq: str) -> int:
    """Microseconds of a frequency such as ``30min``, ``1h`` or ``D``."""
    m = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", fix_frequency(freq))
    if not m or m[2].lower() not in _UNITS or int(m[1]) == 0:
        raise ValueError(f"not a frequency: {freq!r}")
    return int(m[1]) * _UNITS[m[2].lower()]


@dataclass(frozen=True)
class StoreSpec:
    """Keys of the series, the calendar period of a chunk, the time zone of the calendar, the step, and whether the store
    takes part in replication. Checked when made; cannot be changed afterwards."""

    keys: tuple[str, ...]
    chunk_axis: tuple[str, ...] = ("year", "month")
    tz: str = "Europe/Paris"
    freq: str = "1h"
    sync: bool = False
    step_us: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        if len(set(self.keys)) != len(self.keys):
            raise ValueError("keys repeat")
        if taken := set(self.keys) & {"ts", "value", "values", "chunk_index", "start_ts", "updated_at", "is_deleted"}:
            raise ValueError(f"reserved column names: {sorted(taken)}")
        if tuple(self.chunk_axis) not in (("year",), ("year", "month")):
            raise ValueError("chunk_axis is ('year',) or ('year', 'month')")
        object.__setattr__(self, "chunk_axis", tuple(self.chunk_axis))
        try:
            ZoneInfo(self.tz)
        except Exception as e:
            raise ValueError(f"unknown time zone: {self.tz}") from e
        step = frequency_us(self.freq)
        if step > DAY or DAY % step:
            raise ValueError("the step must divide a day, else chunks have no common grid")
        object.__setattr__(self, "step_us", step)

    def signature(self) -> str:
        """A short digest of all options, kept beside the data so that a table is not read with other ones."""
        text = repr((self.keys, self.chunk_axis, self.tz, self.step_us, self.sync))
        return hashlib.sha256(text.encode()).hexdigest()[:16]
