"""Plain Python counterparts used to check the distributed operators."""

import math
from collections import deque
from datetime import timedelta


def km(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def clusters(rows, radius, window):
    """rows: (id, date, lon, lat, rank) -> {id: anchor id}."""
    anchors, owner = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[2], r[3], r[0])):
        for a in anchors:
            if 0 <= (r[1] - a[1]).days <= window and km(r[2:4], a[2:4]) <= radius:
                owner[r[0]] = a[0]
                break
        else:
            anchors.append(r)
            owner[r[0]] = r[0]
    return owner


def matches(dets, refs, radius, window):
    used, out = set(), {}
    for r in sorted(refs, key=lambda r: (r[1], r[0])):
        best = None
        for d in dets:
            gap = abs((d[1] - r[1]).days)
            if d[0] in used or gap > window:
                continue
            dist = km(r[2:4], d[2:4])
            if dist <= radius and (best is None or (gap, round(dist, 9), d[0]) < best):
                best = (gap, round(dist, 9), d[0])
        if best:
            used.add(best[2])
            out[r[0]] = best[2]
    return out


def neighbours(p, eight):
    r, c = p
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    if eight:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    return [(r + a, c + b) for a, b in steps]


def components(pixels, eight):
    """{pixel: first pixel of its component in raster order}."""
    left, label = set(pixels), {}
    for start in sorted(pixels):
        if start in label:
            continue
        queue = deque([start])
        label[start] = start
        while queue:
            for n in neighbours(queue.popleft(), eight):
                if n in left and n not in label:
                    label[n] = start
                    queue.append(n)
    return label


def groups(pixels, eight):
    out = {}
    for p, lab in components(pixels, eight).items():
        out.setdefault(lab, set()).add(p)
    return list(out.values())


def square(p):
    return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def erode(m):
    return {p for p in m if all(q in m for q in square(p))}


def dilate(m):
    return {q for p in m for q in square(p)}


def fill(m, most):
    if not m:
        return m
    r0, r1 = min(p[0] for p in m) - 1, max(p[0] for p in m) + 1
    c0, c1 = min(p[1] for p in m) - 1, max(p[1] for p in m) + 1
    back = {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - m
    for g in groups(back, False):
        if len(g) <= most and not any(r in (r0, r1) or c in (c0, c1) for r, c in g):
            m = m | g
    return m


def keep_source(m, src, size):
    if not m:
        return m
    at = tuple(min(max(round(v), 0), size - 1) for v in src)
    labels = components(m, True)
    if at not in labels:
        at = min(m, key=lambda p: ((p[0] - src[0]) ** 2 + (p[1] - src[1]) ** 2, p))
    return {p for p in m if labels[p] == labels[at]}


def delineate(values, mask, valid, src, wind, size, px=20.0):
    """(kept pixels, counts after each rule)."""
    steps = []
    m = {p for p in mask if valid[p]}
    steps.append(len(m))
    m = {p for p in m if values[p] is not None and 0 < values[p] <= 3600}
    steps.append(len(m))
    m = dilate(erode(m))
    steps.append(len(m))
    m = {p for p in erode(dilate(m)) if 0 <= p[0] < size and 0 <= p[1] < size}
    steps.append(len(m))
    m = fill(m, 25)
    steps.append(len(m))
    m = {p for g in groups(m, True) if len(g) >= 4 for p in g}
    steps.append(len(m))
    m = keep_source(m, src, size)
    steps.append(len(m))
    speed = math.hypot(*wind)
    dr, dc = -wind[1] / speed, wind[0] / speed

    def inside(p):
        y, x = (p[0] - src[0]) * px, (p[1] - src[1]) * px
        along = y * dr + x * dc + 100.0
        return along >= 0 and abs(y * dc - x * dr) <= math.tan(math.radians(60)) * along

    m = {p for p in m if inside(p)}
    steps.append(len(m))
    m = {p for p in m if math.hypot(p[0] - src[0], p[1] - src[1]) * px <= max(speed * 900, 2 * px)}
    steps.append(len(m))
    m = keep_source(m, src, size)
    steps.append(len(m))
    return m, steps


def day(start, n):
    return start + timedelta(days=int(n))
