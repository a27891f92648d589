"""Decision rules: cueing, result status, power branch, public tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, fixed_text

# Verdict words and limits.
BRANCH_FULL = 30
BRANCH_INTERMEDIATE = 15
PUBLIC_GRID_DEG = 0.01
PUBLIC_DELAY_DAYS = 30


def cue_decision(passes, z_peak, *, min_passes: int = 4, z_floor: float = 5.0, revisit_known=None) -> Column:
    """struct(action, reason, counterfactuals) for one verified candidate."""
    n, z = as_col(passes), as_col(z_peak)
    persistent = n >= min_passes
    strong = z >= z_floor
    z1 = fixed_text(z, 1)
    reason = (
        F.when(persistent, F.format_string("persistent source (%d passes)", n.cast("long")))
        .when(strong, F.concat(F.lit("transient ultra-emission (z="), z1, F.lit(f" >= {z_floor})")))
        .otherwise(F.concat(F.lit("weak transient (z="), z1, F.lit(f" < {z_floor})")))
    )
    unknown = F.lit(True) if revisit_known is None else ~as_col(revisit_known)
    empty = F.create_map().cast("map<string,string>")
    what_if = F.when(
        ~persistent,
        F.create_map(
            F.lit("persistence"),
            F.format_string(f"%d < {min_passes}: not promoted to primary", n.cast("long")),
        ),
    ).when(unknown, F.create_map(F.lit("no_revisit_info"), F.lit("cue archive search anyway"))).otherwise(empty)
    return F.struct(
        F.when(persistent | strong, F.lit("cue_sentinel2")).otherwise(F.lit("watch")).alias("action"),
        reason.alias("reason"),
        what_if.alias("counterfactuals"),
    )


def result_status(readable, on_withdrawn_list, on_diagnostic_list, status, superseded, do_not_quote) -> Column:
    """Ordered classification; listed ids win over the record's own flags."""
    def yes(c):
        return F.coalesce(as_col(c), F.lit(False))

    return (
        F.when(~yes(readable), "unreadable")
        .when(yes(on_withdrawn_list), "withdrawn")
        .when(yes(on_diagnostic_list), "diagnostic")
        .when(F.coalesce(as_col(status) == "diagnostic", F.lit(False)), "diagnostic")
        .when(yes(superseded) | yes(do_not_quote), "withdrawn")
        .otherwise("quotable")
    )


def power_branch(n) -> Column:
    return (
        F.when(as_col(n) >= BRANCH_FULL, "full")
        .when(as_col(n) >= BRANCH_INTERMEDIATE, "intermediate")
        .otherwise("descriptive")
    )


def coarsen(degrees_value, step: float = PUBLIC_GRID_DEG) -> Column:
    return F.round(as_col(degrees_value) / step) * step


def old_enough(day, as_of, delay_days: int = PUBLIC_DELAY_DAYS) -> Column:
    return as_col(day) <= F.date_sub(as_col(as_of), delay_days)
