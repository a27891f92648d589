"""Text forms: scene names, noise keys, event keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Name patterns.
SCENE_STAMP = r"^(S2[ABCD])_MSIL1C_(\d{8}T\d{6})_"
ORBIT_TOKEN = r"(?:^|_)(R\d{3})(?=_|$)"
ISO_DAY = r"(\d{4}-\d{2}-\d{2})"
OFFSET_ENTRY = r'<RADIO_ADD_OFFSET\s+band_id="(\d+)">(-?\d+)</RADIO_ADD_OFFSET>'

# Band positions in the 13-entry offset list.
BAND_IDS = {
    "B01": 0, "B02": 1, "B03": 2, "B04": 3, "B05": 4, "B06": 5, "B07": 6,
    "B08": 7, "B8A": 8, "B09": 9, "B10": 10, "B11": 11, "B12": 12,
}


def platform(scene) -> Column:
    return F.split(as_col(scene), "_")[0]


def relative_orbit(scene) -> Column:
    token = F.regexp_extract(as_col(scene), ORBIT_TOKEN, 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("R???"))


def acquisition_time(scene) -> Column:
    stamp = F.regexp_extract(as_col(scene), SCENE_STAMP, 2)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def noise_key(key) -> dict[str, Column]:
    """Parts of ``<basin>_<day>[_cloudscreened|_unscreened][_<N>d][_more]``; ``ok`` is false without basin or day."""
    k = as_col(key)
    parts = r"^(.*?)_*" + ISO_DAY + "(.*)$"
    basin, day, tail = (F.regexp_extract(k, parts, i) for i in (1, 2, 3))
    screening = F.regexp_extract(tail, r"^.*(?:^|_)(cloudscreened|unscreened)(?=_|$)", 1)
    days = F.regexp_extract(tail, r"^.*(?:^|_)(\d+)d(?=_|$)", 1)
    rest = F.regexp_replace(tail, r"(?<=^|_)(?:cloudscreened|unscreened|\d+d)(?=_|$)", "")
    return {
        "ok": (day != "") & (basin != "") & day.try_cast("date").isNotNull(),
        "basin": basin,
        "day": day.try_cast("date"),
        "cloud_screened": F.nullif(screening, F.lit("")) == "cloudscreened",
        "baseline_days": F.nullif(days, F.lit("")).cast("int"),
        "extra": F.array_remove(F.split(rest, "_"), ""),
    }


def band_offset(xml, band) -> Column:
    """Additive DN offset of ``band`` read from scene metadata text; 0 when absent."""
    ids = F.create_map(*[x for k, v in BAND_IDS.items() for x in (F.lit(k), F.lit(str(v)))])
    keys = F.regexp_extract_all(as_col(xml), F.lit(OFFSET_ENTRY), F.lit(1))
    values = F.regexp_extract_all(as_col(xml), F.lit(OFFSET_ENTRY), F.lit(2))
    entry = F.array_position(keys, F.try_element_at(ids, as_col(band)))
    return F.coalesce(
        F.when(entry > 0, F.try_element_at(values, entry.cast("int"))).cast("double"), F.lit(0.0)
    )


def release_event_id(campaign, day) -> Column:
    return F.concat(F.lit("CR-"), as_col(campaign), F.lit("-"), F.date_format(as_col(day), "yyyyMMdd"))
