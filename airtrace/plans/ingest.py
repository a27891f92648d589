"""Queries for sources, sinks and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import background, calibration, report, spatial
from ..session import shared_dir
from ..sources import catalog, imagery, layers, manifest, records
from .registry import Tables, day_text, query, r6
from .sqltext import tree_ctes

_RAW = """CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyyMMdd')
   WHEN 1 THEN concat(date_format(o_orderdate, 'yyyyMMdd'), '.0')
   ELSE CASE WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END END"""


@query(
    "catalog_load",
    """SELECT printf('sron-%05d', row_number() OVER (ORDER BY o_orderkey) - 1) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day,
              lon, lat, rate_t_h, 'sron_weekly' AS source, o_orderstatus AS source_type
       FROM (SELECT *, (o_custkey % 360) - 180e0 AS lon, (o_custkey % 90) * 1e0 AS lat,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS rate_t_h FROM orders)
       WHERE o_orderkey % 97 <> 0 AND NOT (o_orderkey % 3 = 2 AND o_orderkey % 31 = 0)""",
)
def catalog_load(t: Tables):
    raw = t.orders.select(
        F.expr(_RAW).alias("observation_date"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit("bad")).otherwise((F.col("o_custkey") % 360 - 180).cast("string")).alias("longitude"),
        (F.col("o_custkey") % 90).cast("string").alias("lat_deg"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string")).alias("flux"),
        F.col("o_orderstatus").alias("source_type"), "o_orderkey",
    )
    return catalog.canonical_events(raw, [F.col("o_orderkey")]).select(
        "id", day_text("date").alias("day"), "lon", "lat", "rate_t_h", "source", "source_type"
    )


@query(
    "catalog_filter",
    """SELECT id, cast(date AS varchar) AS day, lon, lat FROM v_basin_events
       WHERE lon BETWEEN 58 AND 60 AND lat BETWEEN 38.5 AND 40 AND date >= DATE '2025-02-01' AND date <= DATE '2025-06-30'""",
)
def catalog_filter(t: Tables):
    out = catalog.filter_events(t.v_basin_events, (58, 38.5, 60, 40), "2025-02-01", "2025-06-30")
    return out.select("id", day_text("date").alias("day"), "lon", "lat")


@query(
    "newest_snapshot",
    """SELECT event_id, path FROM (SELECT event_id, concat('mirror/', strftime(ts, '%Y%m%d'), '/catalog.csv') AS path FROM events)
       WHERE path = (SELECT max(concat('mirror/', strftime(ts, '%Y%m%d'), '/catalog.csv')) FROM events)""",
)
def newest_snapshot(t: Tables):
    path = F.concat(F.lit("mirror/"), F.date_format("ts", "yyyyMMdd"), F.lit("/catalog.csv"))
    return catalog.newest_snapshot(t.events.select("event_id", path.alias("path")))


@query("content_manifest")
def content_manifest(t: Tables):
    return manifest.file_manifest(t.spark, f"{t.sf_dir}/*.parquet")


_RANGE, _FAN = 1000, 4


@query(
    "landed_manifest",
    """SELECT nation, sha256(body) AS sha256, octet_length(encode(body)) AS size_bytes, h AS fingerprint, 'file' AS kind FROM body JOIN tree6 USING (nation)""",
    extra=f"""body AS MATERIALIZED (SELECT c_nationkey AS nation, string_agg(concat_ws('|', c_custkey, c_name, c_nationkey), chr(10) ORDER BY c_custkey) || chr(10) AS body FROM customer GROUP BY 1),
     leaf AS (SELECT nation, pos, sha256(substr(body, pos * {_RANGE} + 1, {_RANGE})) AS h FROM (SELECT *, unnest(range((length(body) - 1) // {_RANGE} + 1)) AS pos FROM body)),"""
    + tree_ctes("leaf", "nation", _FAN, 6),
)
def landed_manifest(t: Tables):
    """Files are landed, hashed by byte ranges, recorded in a manifest and read from it again."""
    folder = f"{shared_dir(t.spark)}/landed-{uuid.uuid4().hex}"
    line = F.concat_ws("|", "c_custkey", "c_name", "c_nationkey").alias("line")
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", line)
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "line").write.partitionBy("nation").text(f"{folder}/files")
    files = manifest.file_manifest(t.spark, f"{folder}/files/*", _RANGE, _FAN)
    entries = files.select(F.lit("file").alias("kind"), F.lit("landed").alias("source"), "path", "sha256", "size_bytes", "fingerprint")
    manifest.append_manifest(entries, f"{folder}/manifest")
    nation = F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")
    return manifest.read_manifest(t.spark, f"{folder}/manifest").select(nation, "sha256", "size_bytes", "fingerprint", "kind")


@query(
    "schema_fingerprint",
    """SELECT source, sha256(string_agg(p, ';' ORDER BY p)) AS fingerprint
       FROM (SELECT DISTINCT o_custkey AS source, concat(o_orderpriority, ':', o_orderstatus) AS p FROM orders) GROUP BY 1""",
)
def schema_fingerprint(t: Tables):
    meta = t.orders.select(
        F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("type")
    )
    return manifest.fingerprints(meta)


@query(
    "schema_drift",
    """SELECT source, seq, coalesce(baseline, '') AS baseline, coalesce(fp <> baseline AND NOT ack, false) AS drift FROM (
         SELECT a.*, (SELECT arg_max(b.fp, b.seq) FROM h b WHERE b.source = a.source AND b.seq < a.seq
                      AND (b.ack OR b.seq = b.first)) AS baseline FROM h a)""",
    extra="""h AS (SELECT o_custkey AS source, o_orderkey AS seq, o_orderstatus AS fp, o_orderkey % 5 = 0 AS ack,
                   min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)""",
)
def schema_drift(t: Tables):
    h = t.orders.select(
        F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("fingerprint"), (F.col("o_orderkey") % 5 == 0).alias("acknowledged"),
    )
    return manifest.drift_verdicts(h).select("source", "seq", F.coalesce("baseline", F.lit("")).alias("baseline"), "drift")


@query(
    "manifest_read",
    """SELECT event_type AS kind, count(*) AS n, sum(cast(json_extract(props, '$.k') AS bigint))::bigint AS k_sum
       FROM events GROUP BY 1""",
)
def manifest_read(t: Tables):
    line = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    blank = t.events.select(F.lit("  ").alias("value"))
    parsed = manifest.parse_manifest(t.events.select(line.alias("value")).union(blank), "kind string, k bigint")
    return parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))


def record_texts(t: Tables):
    """Record files as (path, text), some broken, some not objects, some without an id."""
    key = F.col("run_key")
    body = F.to_json(F.struct(
        F.when(key % 8 != 0, F.col("event_id")).alias("event_id"), "basin",
        F.date_format("det_date", "yyyy-MM-dd").alias("det_date"), "result_status", "superseded", "do_not_quote",
        F.col("u10").alias("u10_ms"),
        F.when(F.col("withheld"), F.struct(F.col("q_kg_h").alias("Q"))).alias("q_output_withheld_artifact_dominated"),
        F.when(~F.col("withheld"), F.struct(F.col("q_kg_h").alias("Q"))).alias("q_output"),
    ))
    text = F.when(~F.col("readable"), F.lit('{"event_id": ')).when(key % 25 == 1, F.lit("[1, 2]")).otherwise(body)
    return t.v_runs.select(
        F.concat(F.lit("/store/RUN-"), key.cast("string"), F.lit("/provenance.json")).alias("path"), text.alias("text")
    )


@query(
    "bundle_index",
    """SELECT concat('RUN-', cast(run_key AS varchar)) AS bundle_name,
              CASE WHEN run_key % 8 <> 0 THEN event_id ELSE concat('RUN-', cast(run_key AS varchar)) END AS event_id,
              basin, cast(det_date AS varchar) AS det_date, superseded, q_kg_h AS q
       FROM v_runs WHERE readable AND run_key % 25 <> 1""",
)
def bundle_index(t: Tables):
    q = F.coalesce("q_output.Q", "q_output_withheld_artifact_dominated.Q")
    return records.parse_records(record_texts(t)).select(
        "bundle_name", "event_id", "basin", "det_date", "superseded", q.alias("q")
    )


#: The run settings whose hash every record carries.
RUN_CONFIG = "cue: {min_passes: 4, z_floor: 5.0}\ncontext: {density_limit: 5}\n"


@query(
    "provenance_write",
    f"""SELECT event_id, CASE WHEN run_key % 3 = 0 THEN 'override' ELSE basin END AS basin, CASE WHEN run_key % 3 = 0 THEN 'v2' ELSE '' END AS note,
         cast(det_date AS varchar) AS det_date, (run_key % 360 - 180)::double AS lon, (run_key % 120 - 60)::double AS lat,
         CASE WHEN is_plume THEN 'plume' ELSE 'artifact' END AS event_class, round(z, 6) AS z_peak,
         CASE WHEN n >= 4 OR z >= 5 THEN 'cue_sentinel2' ELSE 'watch' END AS cue_action,
         CASE WHEN n >= 4 THEN concat('persistent source (', n, ' passes)')
              WHEN z >= 5 THEN concat('transient ultra-emission (z=', printf('%.1f', z), ' >= 5.0)')
              ELSE concat('weak transient (z=', printf('%.1f', z), ' < 5.0)') END AS cue_reason,
         CASE WHEN run_key % 9 > 5 THEN 'multiple co-located infrastructure; individual attribution not supported'
              WHEN run_key % 9 = 0 THEN 'no_infrastructure' ELSE 'single_candidate' END AS context_verdict,
         CASE WHEN NOT withheld THEN q_kg_h::double END AS q, CASE WHEN NOT withheld THEN npix::bigint END AS n_pixels,
         'ERA5' AS wind_source, u10 AS u10_ms, true AS stamped, 'r1' AS code_commit, sha256('{RUN_CONFIG}') AS config_sha256
       FROM (SELECT *, run_key % 7 AS n, (run_key % 80) / 10e0 AS z FROM v_runs)
       WHERE NOT (superseded OR do_not_quote) OR NOT readable OR result_status = 'diagnostic'""",
)
def provenance_write(t: Tables):
    none = t.v_runs.where("false").select("event_id")
    stored = report.classify_runs(t.v_runs, none, none)
    key, z = F.col("run_key"), (F.col("run_key") % 80) / 10.0
    cue = policy.cue_decision(key % 7, z)
    events = t.v_runs.select(
        "event_id", "basin", F.date_format("det_date", "yyyy-MM-dd").alias("det_date"), (key % 360 - 180).cast("double").alias("lon"),
        (key % 120 - 60).cast("double").alias("lat"), F.when(F.col("is_plume"), "plume").otherwise("artifact").alias("event_class"),
        z.alias("z_peak"), cue["action"].alias("cue_action"), cue["reason"].alias("cue_reason"),
        spatial.context_verdict(key % 9).alias("context_verdict"),
        F.when(~F.col("withheld"), F.struct(F.col("q_kg_h").cast("double").alias("q_kg_h"), F.col("npix").alias("n_pixels"))).alias("quant"),
        F.lit("ERA5").alias("wind_source"), F.col("u10").alias("u10_ms"),
        F.when(key % 3 == 0, F.create_map(F.lit("basin"), F.lit("override"), F.lit("note"), F.lit("v2"))).alias("extra"),
    )
    rows = report.run_records(events, config=RUN_CONFIG, commit="r1", extra="extra")
    target = f"{shared_dir(t.spark)}/records-{uuid.uuid4().hex}"
    # Written twice: the second batch replaces the first.
    for _ in range(2):
        records.write_records(rows, stored, target)
    read = records.read_written(t.spark, target, rows.schema)
    r = F.from_json(F.to_json("record"), f"{records.RECORD_SCHEMA}, note string")
    return read.select("event_id", r.alias("r")).select(
        "event_id", "r.basin", F.coalesce("r.note", F.lit("")).alias("note"), "r.det_date", "r.lon", "r.lat", "r.event_class", r6("r.z_peak").alias("z_peak"),
        "r.cue_action", "r.cue_reason", "r.context_verdict", F.col("r.quant.q_kg_h").alias("q"), "r.quant.n_pixels", "r.wind_source", "r.u10_ms",
        F.col("r.generated_at").rlike(r"^\d{4}-\d\d-\d\dT.*\+00:00$").alias("stamped"), "r.code_commit", "r.config_sha256",
    )


@query(
    "bundle_integrity",
    "SELECT folder, n_files, h AS integrity FROM tree2 JOIN (SELECT folder, count(*) AS n_files FROM leaf GROUP BY 1) USING (folder)",
    extra="""leaf AS (SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY f) - 1 AS pos, sha256(concat(f, ':', sha256(text))) AS h
       FROM (SELECT doc_id - doc_id % 10 AS folder, cast(doc_id AS varchar) AS f, text FROM documents)), """ + tree_ctes("leaf", "folder", _FAN, 2),
)
def bundle_integrity(t: Tables):
    files = t.documents.select(
        (F.col("doc_id") - F.col("doc_id") % 10).alias("folder"), F.col("doc_id").cast("string").alias("file"),
        F.col("text").alias("content"),
    )
    return records.folder_integrity(files, _FAN)


@query(
    "winds_parse",
    """SELECT site, strftime(date_trunc('second', time), '%Y-%m-%d %H:%M:%S') AS time,
              round(-speed * sin(radians(direction_from)), 6) AS u10, round(-speed * cos(radians(direction_from)), 6) AS v10
       FROM v_winds WHERE event_id % 6 <> 0""",
)
def winds_parse(t: Tables):
    hour = F.struct(
        "time", F.when(F.col("event_id") % 6 != 0, F.col("speed")).alias("s"), F.col("direction_from").alias("d")
    )
    docs = t.v_winds.groupBy("site", F.to_date("time").alias("day")).agg(F.collect_list(hour).alias("h"))
    body = F.to_json(F.struct(F.struct(
        F.transform("h", lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm:ss")).alias("time"),
        F.col("h.s").alias("wind_speed_10m"), F.col("h.d").alias("wind_direction_10m"),
    ).alias("hourly")), {"ignoreNullFields": "false"})
    parsed = layers.parse_hourly_winds(docs.select("site", body.alias("json")))
    return parsed.select(
        "site", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), r6("u10").alias("u10"), r6("v10").alias("v10")
    )


@query("infra_layers", "SELECT layer, type, count(*) AS n, round(min(lon), 6) AS west FROM v_facilities GROUP BY 1, 2")
def infra_layers(t: Tables):
    """Layers as files with a header each; the layer without a file is left out."""
    folder = f"{shared_dir(t.spark)}/layers-{uuid.uuid4().hex}"
    tags = ("flight", "gem", "osm")
    for tag in tags:
        t.v_facilities.where(F.col("layer") == tag).drop("layer").write.option("header", True).csv(f"{folder}/{tag}")
    found = layers.load_layers(t.spark, {**{tag: f"{folder}/{tag}" for tag in tags}, "absent": None})
    return found.groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"), r6(F.min(F.col("lon").cast("double"))).alias("west"))


@query(
    "truth_explode",
    "SELECT campaign, cast(date AS varchar) AS date, kg_h FROM v_truth WHERE kind = 'release'",
)
def truth_explode(t: Tables):
    op = F.struct(day_text("date").alias("date"), F.lit("").alias("utc"), "kg_h", "kind")
    camp = t.v_truth.groupBy("campaign").agg(F.collect_list(op).alias("overpasses"))
    nested = camp.select(F.array(F.struct(F.col("campaign").alias("name"), "overpasses")).alias("campaigns"))
    return layers.explode_truth(nested, kind="release").select("campaign", "date", "kg_h")


@query(
    "calibration_table",
    """SELECT satellite, count(*) AS n_rows, count(DISTINCT sza) * count(DISTINCT vza) AS n_expected,
              count(*) = count(DISTINCT sza) * count(DISTINCT vza) AS complete FROM v_calibration GROUP BY 1""",
)
def calibration_table(t: Tables):
    """The curve table as a file of entries and read back, which refuses an incomplete grid."""
    path = f"{shared_dir(t.spark)}/calibration-{uuid.uuid4().hex}"
    entry = F.struct("satellite", "sza", "vza", "c1", "c2", "c3")
    # The grid is a small fixed table: tens of rows in one document.
    t.v_calibration.agg(F.collect_list(entry).alias("entries")).coalesce(1).write.json(path)
    return calibration.grid_completeness(layers.load_calibration(t.spark, path))


@query(
    "labels_load",
    """SELECT id, id % 7 = 0 AS bad_pass1, id % 10 = 0 AS bad_pass2 FROM v_labels WHERE id % 7 = 0 OR id % 10 = 0""",
)
def labels_load(t: Tables):
    lab = t.v_labels.select(
        "id",
        F.when(F.col("id") % 7 == 0, "smoke").when(F.col("id") % 3 != 0, F.col("pass1")).alias("pass1_morphology"),
        F.when(F.col("id") % 10 == 0, "cloud").otherwise(F.col("pass2")).alias("pass2_final"),
    )
    path = f"{shared_dir(t.spark)}/labels-{uuid.uuid4().hex}"
    lab.write.option("header", True).csv(path)
    back = layers.read_labels(t.spark, path)
    return layers.label_violations(back).select(F.col("id").cast(lab.schema["id"].dataType).alias("id"), "bad_pass1", "bad_pass2")


@query(
    "daily_first_image",
    """SELECT stack, cast(day AS varchar) AS day, image, row, col, round(max(value), 6) AS value FROM obs o
       WHERE image = (SELECT min(image) FROM obs p WHERE p.stack = o.stack AND p.day = o.day)
         AND row BETWEEN 2 AND 13 AND col BETWEEN 1 AND 5 GROUP BY ALL""",
    extra="""obs AS (SELECT cast(l_suppkey % 10 AS int) AS stack, cast(l_shipdate AS date) AS day, l_orderkey AS image,
                cast(l_partkey % 16 AS int) AS row, l_linenumber AS col, l_extendedprice AS value FROM lineitem)""",
)
def daily_first_image(t: Tables):
    obs = t.lineitem.select(
        (F.col("l_suppkey") % 10).cast("int").alias("stack"), F.to_date("l_shipdate").alias("day"),
        F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("row"),
        F.col("l_linenumber").alias("col"), F.col("l_extendedprice").alias("value"),
    )
    return (
        imagery.daily_first_image(obs, ["stack"], (2, 1, 13, 5))
        .groupBy("stack", day_text("day").alias("day"), "image", "row", "col").agg(r6(F.max("value")).alias("value"))
    )


@query(
    "background_composite",
    """SELECT a.stack_id, a.frame, a.row, a.col, round(quantile_cont(b.value, 0.5), 6) AS composite
       FROM v_pixels a JOIN v_pixels b ON a.stack_id = b.stack_id AND a.row = b.row AND a.col = b.col
         AND b.frame * 3 BETWEEN a.frame * 3 - 15 AND a.frame * 3 + 15 GROUP BY 1, 2, 3, 4""",
)
def background_composite(t: Tables):
    px = t.v_pixels.withColumn("obs_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("frame") * 3))
    return background.background_composite(px, ["stack_id", "row", "col"]).select(
        "stack_id", "frame", "row", "col", r6("composite").alias("composite")
    )


@query(
    "union_layers",
    """SELECT tag, count(*) AS n FROM (
         SELECT 'a' AS tag FROM v_basin_events WHERE lon BETWEEN 58 AND 60 AND lat BETWEEN 38.5 AND 40
         UNION ALL SELECT 'b' FROM v_basin_events WHERE lon BETWEEN 59 AND 61 AND lat BETWEEN 38.5 AND 41) GROUP BY 1""",
)
def union_layers(t: Tables):
    a = catalog.filter_events(t.v_basin_events, (58, 38.5, 60, 40)).withColumn("tag", F.lit("a"))
    b = catalog.filter_events(t.v_basin_events, (59, 38.5, 61, 41)).withColumn("tag", F.lit("b"))
    return a.unionByName(b).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_passes",
    """SELECT event, string_agg(p, ',' ORDER BY p) AS passes FROM (
         SELECT DISTINCT event, split_part(scene, '_', 1) || '-' || cast(dt_days AS varchar) AS p FROM v_passes) GROUP BY 1""",
)
def distinct_passes(t: Tables):
    p = t.v_passes.select("event", F.concat_ws("-", F.split("scene", "_")[0], "dt_days").alias("p")).distinct()
    return p.groupBy("event").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("passes"))


@query(
    "set_diff",
    "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
def set_diff(t: Tables):
    k = F.col("o_custkey").alias("k")
    return t.orders.where("o_orderstatus = 'F'").select(k).exceptAll(t.orders.where("o_orderstatus = 'O'").select(k))


@query(
    "priority_order_limit",
    """SELECT overpass_key, kind, kg_h FROM v_truth
       ORDER BY CASE kind WHEN 'zero_control' THEN 0 WHEN 'release' THEN 1 WHEN 'no_release' THEN 2 ELSE 9 END, kg_h DESC, overpass_key LIMIT 5000""",
)
def priority_order_limit(t: Tables):
    return report.run_priority(t.v_truth, ["overpass_key"]).limit(5000).select("overpass_key", "kind", "kg_h")
