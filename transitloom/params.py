"""Settings of the engine, with the defaults of the study it serves."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date


@dataclass(frozen=True)
class Params:
    osm_snapshot: date = date(2026, 9, 1)
    feed_snapshot: date = date(2026, 9, 1)
    air_timezone_date: date = date(2026, 1, 1)
    tz_reference: date = date(2025, 1, 15)
    min_city_population: int = 200_000
    service_start: date = date(2023, 1, 1)
    service_end: date = date(2026, 12, 31)
    calendar_start: date = date(2020, 1, 1)
    calendar_end: date = date(2030, 1, 1)
    stop_cluster_radius_m: float = 400.0
    station_buffer_m: float = 400.0
    max_station_offset_m: float = 5_000.0
    airport_catchment_m: float = 150_000.0
    airport_station_m: float = 400.0
    routing_buffer_km: float = 10.0
    max_stop_sequence: int = 65_535

    @property
    def total_days(self) -> int:
        return (self.service_end - self.service_start).days + 1

    @classmethod
    def from_yaml(cls, path: str) -> Params:
        """Defaults overridden by the keys of a YAML file that name a field, in any case."""
        import yaml

        with open(path) as f:
            given = {str(k).lower(): v for k, v in (yaml.safe_load(f) or {}).items()}
        return cls(**{x.name: given[x.name] for x in fields(cls) if x.name in given})


DEFAULTS = Params()
#: Route types that count as rail and as bus.
RAIL_TYPES = (2, 100, 101, 102, 103, 105, 106, 107, 108, 109, 111, 113, 114, 117, 900, 901, 902, 903, 904, 905, 906)
BUS_TYPES = (3, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 700, 701, 702, 703, 704, 705, 706, 707, 708, 709, 710, 711, 712, 713, 714, 715, 716)
