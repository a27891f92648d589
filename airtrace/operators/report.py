"""Result records: status, write guard, withholding, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import result_status


def classify_runs(runs: DataFrame, withdrawn: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """Add ``status``; the two lists hold ``event_id``. Left to AQE to broadcast when small."""
    w = withdrawn.select("event_id").distinct().withColumn("_w", F.lit(True))
    d = diagnostic.select("event_id").distinct().withColumn("_d", F.lit(True))
    status = result_status("readable", "_w", "_d", "result_status", "superseded", "do_not_quote")
    return (
        runs.join(w, "event_id", "left").join(d, "event_id", "left").withColumn("status", status).drop("_w", "_d")
    )


def guard_withdrawn(new: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """New records whose id is not stored as withdrawn; all of them when forced."""
    if force:
        return new
    return new.join(stored.where("status = 'withdrawn'").select("event_id"), "event_id", "left_anti")


#: What every run record tells, in this order.
RECORD_FIELDS = [
    "event_id", "basin", "det_date", "lon", "lat", "event_class", "z_peak", "cue_action", "cue_reason", "context_verdict",
    "quant", "wind_source", "u10_ms", "generated_at", "code_commit", "config_sha256",
]


def provenance_record(core: dict[str, Column], types: dict[str, str], extra: Column) -> Column:
    """One variant object per event; entries of the map ``extra`` replace core entries of the same name.

    ``types`` has the type names of the core columns: nested ones become objects
    and lists of the record. A core value that is NULL stays as null, so a
    record of a detection without a rate says so.
    """
    def as_variant(name):
        return F.to_variant_object(core[name]) if types[name].startswith(("struct", "array", "map")) else core[name].cast("variant")

    own = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), as_variant(n).alias("value")) for n in core]))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k))
    merged = F.to_variant_object(F.map_concat(kept, F.transform_values(extra, lambda _, v: v.cast("variant"))))
    # Most records have no entries of their own: theirs is the core as it is, without maps.
    return F.when(F.size(extra) > 0, merged).otherwise(F.to_variant_object(F.struct(*[core[n].alias(n) for n in core])))


def run_records(events: DataFrame, *, config: str, commit: str = "unknown", extra: str | None = None) -> DataFrame:
    """``event_id, basin, record`` of events with the columns of ``RECORD_FIELDS`` that are theirs.

    ``config`` is the text of the run's settings, of which the hash is recorded;
    ``extra`` names a column of further entries (map of strings, NULL for none).
    """
    stamped = events.withColumns({
        "generated_at": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        "code_commit": F.lit(commit), "config_sha256": F.sha2(F.lit(config), 256),
    })
    none = F.create_map().cast("map<string,string>")
    own = none if extra is None else F.coalesce(F.col(extra), none)
    types = dict(stamped.dtypes)
    record = provenance_record({n: F.col(n) for n in RECORD_FIELDS}, {n: types[n] for n in RECORD_FIELDS}, own)
    return stamped.select("event_id", "basin", record.alias("record"))


def withhold(rate: Column, n_pixels: Column, artifact: Column, min_pixels: int = 20) -> tuple[Column, Column]:
    """(quotable rate, withheld rate): exactly one carries a value once the mask is large enough."""
    enough = n_pixels >= min_pixels
    return F.when(enough & ~artifact, rate), F.when(enough & artifact, rate)


def dossier(quantified: Column, fields: list[str], quant_fields: list[str]) -> Column:
    """Nested evidence record; ``quant`` is absent for detection-only events."""
    quant = F.when(quantified, F.struct(*[F.col(q) for q in quant_fields]))
    return F.struct(*[F.col(f) for f in fields], quant.alias("quant"))


# Run order by kind of overpass.
KIND_ORDER = {"zero_control": 0, "release": 1, "no_release": 2}


def run_priority(overpasses: DataFrame, tie: list[str]) -> DataFrame:
    """Zero controls, then releases by falling rate, then no-release overpasses."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_ORDER.items()], F.lit(9))
    return overpasses.orderBy(rank, F.coalesce("kg_h", F.lit(0.0)).desc(), *tie)
