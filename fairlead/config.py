"""Settings: parsed from a properties file, every key required, checked before anything runs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Statistical:
    enabled: bool = True
    least_count: int = 5000
    pd: float = 0.001
    least_length: int = 50
    prediction_minutes: int = 10
    over_all_types: bool = False


@dataclass(frozen=True)
class Drift:
    enabled: bool = True
    period_minutes: int = 10
    metres: float = 500.0
    least_sog: float = 1.0
    most_sog: float = 5.0
    angle: float = 45.0
    least_length: int = 50
    prediction_minutes: int = 10


@dataclass(frozen=True)
class SuddenSpeedChange:
    enabled: bool = True
    high: float = 7.0
    low: float = 1.0
    decay_seconds: int = 30
    sustain_seconds: int = 60
    least_length: int = 50
    prediction_minutes: int = 10


@dataclass(frozen=True)
class CloseEncounter:
    enabled: bool = True
    run_seconds: int = 30
    least_sog: float = 5.0
    prediction_minutes: int = 10
    length: float = 2.0
    breadth: float = 3.0
    behind: float = 0.25


@dataclass(frozen=True)
class FreeFlow:
    enabled: bool = True
    run_seconds: int = 60
    along: float = 8.0
    across: float = 8.0
    course_degrees: float = 15.0
    report_minutes: int = 30
    prediction_minutes: int = 10
    box: tuple[float, float, float, float] | None = (55.8, 11.2, 54.7, 10.6)  # north, east, south, west


@dataclass(frozen=True)
class Settings:
    black_list: tuple[int, ...] = (-1,)
    grid_metres: float = 200.0
    dump_seconds: int = 3600
    down_sample_seconds: int = 5
    bounds: tuple[float, float, float, float] | None = (58.0, 54.4, 7.0, 16.0)  # north, south, west, east
    skip_names: tuple[str, ...] = ()
    expression: str = ""
    stale_minutes: int = 30
    mask: tuple[tuple[float, float, float, float], ...] = ()  # boxes (south, north, west, east) whose reports are left out
    interpolation_seconds: int = 10  # step of dead-reckoned reports in gaps; 0 makes none
    course: Statistical = field(default_factory=Statistical)
    speed: Statistical = field(default_factory=Statistical)
    type_size: Statistical = field(default_factory=Statistical)
    drift: Drift = field(default_factory=Drift)
    speed_change: SuddenSpeedChange = field(default_factory=SuddenSpeedChange)
    encounter: CloseEncounter = field(default_factory=CloseEncounter)
    free_flow: FreeFlow = field(default_factory=FreeFlow)


_STATISTICAL = ("enabled", "predictiontime.max", "cell.shipcount.min", "pd", "loa.min")
# The keys that a settings file must have, by group.
KEYS: tuple[str, ...] = (
    "blacklist.mmsi",
    "application.stats.dump.period", "application.grid.resolution.default",
    "filter.location.bbox.north", "filter.location.bbox.south", "filter.location.bbox.west", "filter.location.bbox.east",
    "filter.shipname.skip", "filter.custom.expression",
    *(f"analysis.{a}.{k}" for a in ("cog", "sog") for k in (*_STATISTICAL, "aggregatestats.over.shiptype")),
    *(f"analysis.typesize.{k}" for k in _STATISTICAL),
    *(f"analysis.drift.{k}" for k in ("enabled", "period", "distance", "sog.min", "sog.max", "coghdg", "loa.min", "predictiontime.max")),
    *(f"analysis.suddenspeedchange.{k}" for k in ("enabled", "sog.highmark", "sog.lowmark", "drop.decay", "drop.sustain", "loa.min", "predictiontime.max")),
    *(f"analysis.closeencounter.{k}" for k in ("enabled", "run.period", "sog.min", "predictiontime.max")),
    *(f"analysis.freeflow.{k}" for k in ("enabled", "run.period", "bbox", "xl", "xb", "dcog", "reportingperiod.min", "predictiontime.max", "csvfile")),
    "statistics.file",
    "events.repository.type", "events.pgsql.host", "events.pgsql.port", "events.pgsql.name", "events.pgsql.username", "events.pgsql.password", "events.h2.file", "events.csv.file",
    "ais.datasource.url", "ais.datasource.downsampling",
    "reports.enabled", "reports.recentevents.cron",
    *(f"reports.mailer.smtp.{k}" for k in ("host", "port", "user", "pass", "ssl", "from", "to")),
    *(f"service.safetyzone.safety.ellipse.{k}" for k in ("length", "breadth", "behind")),
)

_POSITIVE = ("application.stats.dump.period", "application.grid.resolution.default", "analysis.closeencounter.run.period", "analysis.freeflow.run.period", "analysis.drift.period")
STORES = ("h2", "pgsql", "csv", "parquet")


def parse_properties(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` and ``!`` begin comments."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def problems(values: Mapping[str, str]) -> list[str]:
    """What is wrong with a settings file; empty if it can be used."""
    out = [f"missing key {k}" for k in KEYS if k not in values]

    def number(key: str, least: float, strict: bool = False) -> None:
        text = values.get(key, "")
        try:
            value = float(text)
        except ValueError:
            out.append(f"{key} is no number: {text!r}")
            return
        if value < least or (strict and value == least):
            out.append(f"{key} must be {'above' if strict else 'at least'} {least:g}")

    for key in KEYS:
        if key not in values:
            continue
        if key in _POSITIVE:
            number(key, 0, strict=True)
        elif key.endswith((".pd", ".loa.min", ".shipcount.min", ".sog.min", ".sog.max", ".coghdg", ".distance", ".highmark", ".lowmark", ".decay", ".sustain", ".xl", ".xb", ".dcog", ".reportingperiod.min", ".length", ".breadth", ".behind", ".downsampling")):
            number(key, 0)
        elif key.endswith(".predictiontime.max"):
            number(key, -1)
        elif key.startswith("filter.location.bbox.") and values[key]:
            number(key, -180)
        elif key.endswith(".enabled") and values[key].lower() not in ("true", "false"):
            out.append(f"{key} must be true or false")
    store = values.get("events.repository.type", "").lower().strip()
    if store not in STORES:
        out.append(f"events.repository.type must be one of {', '.join(STORES)}")
    if store == "parquet" and not values.get("events.parquet.path", "").strip():
        out.append("events.parquet.path is blank")
    if store == "pgsql":
        out += [f"{k} is blank" for k in KEYS if k.startswith("events.pgsql.") and not values.get(k, "").strip()]
    box = values.get("analysis.freeflow.bbox", "")
    if box.strip() and len(_floats(box)) != 4:
        out.append("analysis.freeflow.bbox needs four numbers: north, east, south, west")
    return out


def _floats(text: str) -> list[float]:
    try:
        return [float(x) for x in text.strip(' "').split(",")]
    except ValueError:
        return []


def settings(values: Mapping[str, str], mask: Iterable[tuple[float, float, float, float]] = ()) -> Settings:
    """Settings of a file that has no problems, else ValueError names them; ``mask`` as ``filters.mask_boxes`` reads it."""
    wrong = problems(values)
    if wrong:
        raise ValueError("; ".join(wrong))
    v = values
    on = lambda key: v[key].lower() == "true"
    whole = lambda key: int(float(v[key]))

    def learned(name: str) -> Statistical:
        at = f"analysis.{name}."
        return Statistical(on(at + "enabled"), whole(at + "cell.shipcount.min"), float(v[at + "pd"]), whole(at + "loa.min"), whole(at + "predictiontime.max"), v.get(at + "aggregatestats.over.shiptype", "false").lower() == "true")

    bounds = [v[f"filter.location.bbox.{side}"] for side in ("north", "south", "west", "east")]
    box = _floats(v["analysis.freeflow.bbox"])
    d, s, c, f, z = "analysis.drift.", "analysis.suddenspeedchange.", "analysis.closeencounter.", "analysis.freeflow.", "service.safetyzone.safety.ellipse."
    return Settings(
        black_list=tuple(int(x) for x in v["blacklist.mmsi"].split(",") if x.strip()),
        grid_metres=float(v["application.grid.resolution.default"]),
        dump_seconds=whole("application.stats.dump.period"),
        down_sample_seconds=whole("ais.datasource.downsampling"),
        bounds=tuple(map(float, bounds)) if all(x.strip() for x in bounds) else None,
        skip_names=tuple(x.strip() for x in v["filter.shipname.skip"].split(",") if x.strip()),
        expression=v["filter.custom.expression"],
        mask=tuple(mask),
        course=learned("cog"),
        speed=learned("sog"),
        type_size=learned("typesize"),
        drift=Drift(on(d + "enabled"), whole(d + "period"), float(v[d + "distance"]), float(v[d + "sog.min"]), float(v[d + "sog.max"]), float(v[d + "coghdg"]), whole(d + "loa.min"), whole(d + "predictiontime.max")),
        speed_change=SuddenSpeedChange(on(s + "enabled"), float(v[s + "sog.highmark"]), float(v[s + "sog.lowmark"]), whole(s + "drop.decay"), whole(s + "drop.sustain"), whole(s + "loa.min"), whole(s + "predictiontime.max")),
        encounter=CloseEncounter(on(c + "enabled"), whole(c + "run.period"), float(v[c + "sog.min"]), whole(c + "predictiontime.max"), float(v[z + "length"]), float(v[z + "breadth"]), float(v[z + "behind"])),
        free_flow=FreeFlow(on(f + "enabled"), whole(f + "run.period"), float(v[f + "xl"]), float(v[f + "xb"]), float(v[f + "dcog"]), whole(f + "reportingperiod.min"), whole(f + "predictiontime.max"), tuple(box) if len(box) == 4 else None),
    )
