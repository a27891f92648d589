"""Reusable SQL fragments for the reference queries."""


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371.0088 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


MASS = "(1e-9 * (16.043 / 28.965) * ({p} * 100 / 9.80665))"


def mass(ppb: str, pressure: str = "1013.0") -> str:
    return f"({ppb}) * " + MASS.format(p=pressure)


UEFF = "(0.33 * {u} + 0.45)"
MOD = "({x} - floor({x} / {n}) * {n})"


def mod(x: str, n: str) -> str:
    """Non-negative remainder of doubles."""
    return f"(({x}) - floor(({x}) / {n}) * {n})"


INTERP = """
 known AS (SELECT max(CASE WHEN satellite = 'S2B' THEN 'S2B' END) AS b, min(satellite) AS f FROM cal),
 lim AS (SELECT satellite, min(sza) AS s_lo, max(sza) AS s_hi, min(vza) AS v_lo, max(vza) AS v_hi FROM cal GROUP BY 1),
 geo AS (SELECT g.*, CASE WHEN g.satellite IN (SELECT satellite FROM cal) THEN g.satellite
                ELSE coalesce(k.b, k.f) END AS sat FROM scenes g, known k),
 cl AS (SELECT g.*, least(greatest(g.sza, s_lo), s_hi) AS s, least(greatest(g.vza, v_lo), v_hi) AS v, s_lo, v_lo
        FROM geo g JOIN lim ON lim.satellite = g.sat),
 br AS (SELECT cl.*,
   (SELECT max(sza) FROM cal c WHERE c.satellite = cl.sat AND (c.sza < cl.s OR c.sza = cl.s_lo)) AS s0,
   (SELECT max(vza) FROM cal c WHERE c.satellite = cl.sat AND (c.vza < cl.v OR c.vza = cl.v_lo)) AS v0 FROM cl),
 br2 AS (SELECT br.*,
   (SELECT min(sza) FROM cal c WHERE c.satellite = br.sat AND c.sza > br.s0) AS s1,
   (SELECT min(vza) FROM cal c WHERE c.satellite = br.sat AND c.vza > br.v0) AS v1 FROM br),
 w AS (SELECT *, (s - s0) / (s1 - s0) AS ts, (v - v0) / (v1 - v0) AS tv FROM br2),
 curve AS (SELECT w.scene_key,
   any_value(w.satellite) AS satellite, any_value(w.log_ratio) AS log_ratio,
   sum(c1 * wt) AS c1, sum(c2 * wt) AS c2, sum(c3 * wt) AS c3
   FROM (SELECT w.*, c.c1, c.c2, c.c3,
          (CASE WHEN c.sza = s0 THEN 1 - ts ELSE ts END) * (CASE WHEN c.vza = v0 THEN 1 - tv ELSE tv END) AS wt
         FROM w JOIN cal c ON c.satellite = w.sat AND c.sza IN (s0, s1) AND c.vza IN (v0, v1)) w
   GROUP BY w.scene_key)"""


def pairs_sql(left: str, right: str, km: float, days: int, one_sided: bool = False) -> str:
    """Pairs (a from left, b from right) within a radius and day window, by latitude bands."""
    gap = "date_diff('day', b.date, a.date)"
    when = f"{gap} BETWEEN 0 AND {days}" if one_sided else f"abs({gap}) <= {days}"
    d = hav("a.lon", "a.lat", "b.lon", "b.lat")
    return f"""SELECT a.id AS aid, b.id AS bid, a.date AS adate, b.date AS bdate, abs({gap}) AS dt, {d} AS dist,
          a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
        FROM (SELECT *, cast(floor(lat / 0.4) AS int) + o AS band FROM {left}, (SELECT unnest([-1, 0, 1]) AS o)) a
        JOIN (SELECT *, cast(floor(lat / 0.4) AS int) AS band FROM {right}) b USING (band)
        WHERE {when} AND {d} <= {km}"""


def match_ctes(refs: str = "v_reference", dets: str = "v_detections", tag: str = "", km: float = 25, days: int = 3) -> str:
    """Recursive walk over references inside each component; the result is ``{tag}matches``."""
    t = tag
    return f"""{t}p AS MATERIALIZED ({pairs_sql(refs, dets, km, days)}),
 {t}e AS (SELECT aid AS a, bid AS b FROM {t}p UNION ALL SELECT bid, aid FROM {t}p),
 {t}reach(n, m) AS (SELECT DISTINCT a, a FROM {t}e UNION SELECT r.n, e.b FROM {t}reach r JOIN {t}e e ON e.a = r.m),
 {t}comp AS MATERIALIZED (SELECT n, min(m) AS c FROM {t}reach GROUP BY n),
 {t}rr AS MATERIALIZED (SELECT c, aid, row_number() OVER (PARTITION BY c ORDER BY adate, aid) AS k,
                 cands FROM (SELECT aid, any_value(adate) AS adate, list(bid ORDER BY dt, round(dist, 9), bid) AS cands FROM {t}p GROUP BY aid) x
                 JOIN {t}comp ON comp_n(n, aid)),
 {t}walk(c, k, used, aid, pick) AS (
   SELECT DISTINCT c, 0::bigint, []::varchar[], NULL::varchar, NULL::varchar FROM {t}rr
   UNION ALL
   SELECT w.c, r.k, CASE WHEN list_filter(r.cands, lambda x: NOT list_contains(w.used, x))[1] IS NULL THEN w.used
       ELSE list_append(w.used, list_filter(r.cands, lambda x: NOT list_contains(w.used, x))[1]) END,
     r.aid, list_filter(r.cands, lambda x: NOT list_contains(w.used, x))[1]
   FROM {t}walk w JOIN {t}rr r ON r.c = w.c AND r.k = w.k + 1),
 {t}matches AS MATERIALIZED (SELECT w.aid AS ref_id, w.pick AS det_id, round(p.dist, 3) AS dist_km, p.dt AS dt_days
   FROM {t}walk w JOIN {t}p p ON p.aid = w.aid AND p.bid = w.pick WHERE w.pick IS NOT NULL)""".replace("comp_n(n, aid)", "n = aid")


def cluster_ctes(events: str, km: float, days: int, tag: str = "", order: str = "date, lon, lat, id") -> str:
    """First-fit anchors inside each component; the result is ``{tag}member(id, anchor)``.

    ``events`` names a relation with ``id, date, lon, lat`` (and what ``order`` needs).
    """
    t = tag
    return f"""{t}o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS k0 FROM {events}),
 {t}q AS MATERIALIZED (SELECT p.aid, p.bid, x.k0 AS ka, y.k0 AS kb FROM ({pairs_sql(events, events, km, days, True)}) p
        JOIN {t}o x ON x.id = p.aid JOIN {t}o y ON y.id = p.bid WHERE y.k0 <= x.k0),
 {t}e AS (SELECT aid AS a, bid AS b FROM {t}q UNION ALL SELECT bid, aid FROM {t}q),
 {t}reach(n, m) AS (SELECT DISTINCT a, a FROM {t}e UNION SELECT r.n, e.b FROM {t}reach r JOIN {t}e e ON e.a = r.m),
 {t}comp AS MATERIALIZED (SELECT n, min(m) AS c FROM {t}reach GROUP BY n),
 {t}rr AS MATERIALIZED (SELECT c, aid, row_number() OVER (PARTITION BY c ORDER BY ka) AS k, cands
        FROM (SELECT aid, any_value(ka) AS ka, list(bid ORDER BY kb) AS cands FROM {t}q GROUP BY aid) x JOIN {t}comp ON n = aid),
 {t}walk(c, k, anchors, id, anchor) AS (
   SELECT DISTINCT c, 0::bigint, []::varchar[], NULL::varchar, NULL::varchar FROM {t}rr
   UNION ALL
   SELECT w.c, r.k,
     CASE WHEN list_filter(r.cands, lambda x: list_contains(w.anchors, x))[1] IS NULL THEN list_append(w.anchors, r.aid) ELSE w.anchors END,
     r.aid, coalesce(list_filter(r.cands, lambda x: list_contains(w.anchors, x))[1], r.aid)
   FROM {t}walk w JOIN {t}rr r ON r.c = w.c AND r.k = w.k + 1),
 {t}member AS MATERIALIZED (SELECT id, anchor FROM {t}walk WHERE id IS NOT NULL)"""


def mixed_sql(rows: str) -> str:
    """``rows`` with its 32-bit numbers ``h`` scrambled by two rounds of multiply and shift."""
    out = rows
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = f"SELECT * REPLACE ((xor(h, h >> {shift}::ubigint) * {factor}::ubigint) & 4294967295::ubigint AS h) FROM ({out})"
    return f"SELECT * REPLACE (xor(h, h >> 16::ubigint) AS h) FROM ({out})"


def bootstrap_sql(clusters: str, draws: int, seed: int = 20270307) -> str:
    """Interval of sum(tp)/sum(n) over counted cluster picks; ``clusters`` has ``cluster, n, tp``."""
    step = "(({key})::ubigint + ({count} + 1)::ubigint * 2654435769::ubigint) & 4294967295::ubigint"
    first = mixed_sql(f"SELECT draw, {step.format(key=seed, count='draw')} AS h FROM (SELECT unnest(range({draws})) AS draw)")
    both = mixed_sql(f"SELECT draw, h AS one, xor(h, 1540483477::ubigint) AS h FROM ({first})")
    once = mixed_sql(f"SELECT draw, a.h AS two, {step.format(key='one', count='slot')} AS h FROM ({both}) a, (SELECT row_number() OVER () - 1 AS slot FROM {clusters})")
    picks = mixed_sql(f"SELECT draw, xor(h, two) AS h FROM ({once})")
    return f"""SELECT quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high FROM (
        SELECT draw, sum(tp) / sum(n) AS stat FROM (SELECT draw, (h % k::ubigint)::bigint AS pick FROM ({picks}), (SELECT count(*) AS k FROM {clusters})) z
        JOIN (SELECT row_number() OVER (ORDER BY n, tp) - 1 AS slot, n, tp FROM {clusters}) c ON c.slot = z.pick GROUP BY draw)"""


# The sun's unit vector (x, y, z) in equatorial axes from its ecliptic longitude, and its product with the vertical.
SOLAR_STEPS = """
 ecliptic AS (SELECT *, radians(280.460 + 0.9856474 * n + 1.915 * sin(radians(357.528 + 0.9856003 * n)) + 0.020 * sin(2 * radians(357.528 + 0.9856003 * n))) AS along,
        radians(23.439 - 0.0000004 * n) AS axis, radians((18.697374558 + 24.06570982441908 * n) * 15 + lon) AS turn FROM sun),
 sky AS (SELECT *, cos(radians(lat)) * (cos(turn) * cos(along) + sin(turn) * cos(axis) * sin(along)) + sin(radians(lat)) * sin(axis) * sin(along) AS upward FROM ecliptic)"""


def component_ctes(src: str, tag: str = "", eight: bool = False) -> str:
    """Component of each pixel of ``src(s, r, c)`` by flood fill; the result is ``{tag}lab(s, r, c, label)``."""
    t = tag
    near = "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1" if eight else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return f"""{t}nb AS MATERIALIZED (SELECT a.s, a.r AS ar, a.c AS ac, b.r, b.c FROM {src} a JOIN {src} b ON a.s = b.s AND {near}),
 {t}fill(s, lr, lc, r, c) AS (SELECT s, r, c, r, c FROM {src}
    UNION SELECT f.s, f.lr, f.lc, n.r, n.c FROM {t}fill f JOIN {t}nb n ON n.s = f.s AND n.ar = f.r AND n.ac = f.c),
 {t}lab AS MATERIALIZED (SELECT s, r, c, min(lr * 4294967296 + lc)::bigint AS label FROM {t}fill GROUP BY 1, 2, 3)"""


def tree_ctes(leaves: str, key: str, fan: int, levels: int) -> str:
    """``tree{levels}`` (key, n, h) with one row per group from leaves (key, pos, h): hashes of ``fan`` children a level."""
    out = [f"tree0 AS (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for k in range(levels):
        out.append(
            f"tree{k + 1} AS (SELECT {key}, pos // {fan} AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, "
            f"(any_value(n) + {fan - 1}) // {fan} AS n FROM tree{k} GROUP BY {key}, pos // {fan})"
        )
    return ", ".join(out)
