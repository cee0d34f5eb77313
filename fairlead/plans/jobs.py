"""The two jobs: learn statistics from reports, and detect events against them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fairlead.config import Settings
from fairlead.functions.geo import Grid
from fairlead.operators import analyses, event_tables, events, filters, pairs, search, statistics, tracks
from fairlead.operators.statistics import COURSE, SPEED, TYPE_SIZE
from fairlead.sources import event_files, event_store, nmea, relational, scratch, statistics_store


def tracked(positions: DataFrame, statics: DataFrame, settings: Settings) -> DataFrame:
    """Reports with static data, epochs and cells, after all filters in their order.

    The reference masks detection only: to learn as it does, use settings without a mask.
    """
    rows = filters.within_box(positions, *(settings.bounds or (None,) * 4))
    if settings.mask:
        boxes = positions.sparkSession.createDataFrame(list(settings.mask), "south double, north double, west double, east double")
        rows = filters.outside_mask(rows, boxes)
    rows = filters.without_vessels(rows, settings.black_list)
    rows = filters.down_sample(rows, settings.down_sample_seconds)
    rows = tracks.as_of_static(rows, statics)
    rows = filters.where(filters.without_names(rows, settings.skip_names), settings.expression)
    return tracks.with_cells(tracks.with_epochs(rows, settings.stale_minutes), Grid(settings.grid_metres))


def from_files(spark: SparkSession, url: str, settings: Settings) -> DataFrame:
    positions, statics = nmea.reports(nmea.distinct_messages(nmea.messages(nmea.packets(nmea.source(spark, url)))))
    return tracked(positions, statics, settings)


def build_statistics(reports: DataFrame, path: str, settings: Settings) -> int:
    """Learn from all cell changes and store a new version; returns its number."""
    learned = statistics.train(tracks.cell_changes(reports))
    return statistics_store.write(learned, path, statistics_store.Metadata(Grid(settings.grid_metres).resolution, settings.down_sample_seconds))


def add_statistics(reports: DataFrame, path: str, settings: Settings) -> int:
    """Learn from new reports and add them to the stored counts."""
    _, metadata = statistics_store.read_metadata(reports.sparkSession, path)
    return statistics_store.append(statistics.train(tracks.cell_changes(reports)), path, metadata)


@dataclass
class Detected:
    """The event store's tables over all enabled analyses, and free-flow pairs; what is switched off is None."""

    events: DataFrame | None
    behaviours: DataFrame | None
    points: DataFrame | None
    flow: DataFrame | None


def filled(reports: DataFrame, settings: Settings) -> DataFrame:
    """Reports and dead-reckoned ones in the gaps of their tracks, each with the cell where it lies."""
    if settings.interpolation_seconds <= 0:
        return reports
    return tracks.with_cells(tracks.interpolated(reports, settings.interpolation_seconds, settings.stale_minutes * 60), Grid(settings.grid_metres))


def detect(reports: DataFrame, stats: DataFrame, settings: Settings) -> Detected:
    """All enabled analyses over one history of reports.

    Statistical analyses and drift also see dead-reckoned reports.  Sudden speed changes see only what was
    reported, as a speed kept up through a gap would turn a slow change into a sudden one; so do pairs,
    which predict positions on their own.
    """
    if search.missing_statistics(stats).take(1):
        raise ValueError(f"the statistics lack {TYPE_SIZE}")
    dense = filled(reports, settings)
    which = {COURSE: (settings.course, events.COURSE), SPEED: (settings.speed, events.SPEED), TYPE_SIZE: (settings.type_size, events.TYPE_SIZE)}
    which = {statistic: how for statistic, how in which.items() if how[0].enabled}
    parts = []
    if which:
        parts.append(lambda: event_tables.of_statistics(scratch.written(tracks.cell_changes(dense), "changes"), stats, which))
    if settings.drift.enabled:
        parts.append(lambda: [event_tables.of_states(analyses.drift(dense, settings.drift), events.DRIFT)])
    if settings.speed_change.enabled:
        parts.append(lambda: [event_tables.of_speed_changes(analyses.sudden_speed_changes(reports, settings.speed_change))])
    if settings.encounter.enabled:
        parts.append(lambda: [event_tables.of_encounters(analyses.encounter_runs(reports, settings.encounter), reports)])
    found = [tables for part in scratch.at_once(*parts) for tables in part]
    flow = None
    if settings.free_flow.enabled:
        flow = pairs.throttled(analyses.free_flow(reports, settings.free_flow), settings.free_flow.report_minutes * 60_000)
    tables = event_tables.combined(found) if found else None
    return Detected(tables and tables.events, tables and tables.behaviours, tables and tables.points, flow)


def store(found: Detected, values: Mapping[str, str], merge: bool = False) -> None:
    """Put what a run detected where its settings file says: events in the relational store, the file store or as CSV, pairs as CSV.

    The CSV file gets past events only, as its format has no others, and every run's below a folder of its own rows.
    """
    if found.events is not None and values.get("events.repository.type", "").strip().lower() == "parquet":
        event_store.save(event_tables.Tables(found.events, found.behaviours, found.points), values["events.parquet.path"], merge=merge)
    elif found.events is not None:
        address = relational.url_of(values)
        if address is None:
            event_files.write_csv(event_files.event_rows(found.events, found.behaviours, found.points), values["events.csv.file"])
        else:
            relational.save(event_tables.Tables(found.events, found.behaviours, found.points), *address, merge=merge)
    if found.flow is not None:
        event_files.write_csv(event_files.free_flow_rows(found.flow), values["analysis.freeflow.csvfile"])
