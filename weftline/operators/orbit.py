"""Satellites: propagation, orbital shells and planes, the laser mesh, serving choices and the traffic estimate.

The propagator is the published near-earth SGP4 model (Spacetrack Report 3 with the later corrections, WGS-72 constants), vectorised over
satellites and times in Arrow batches. Shells, planes and the mesh depend on order within a group, so they are grouped functions;
a group is one inclination band, one shell or one pair of planes: hundreds of satellites.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# WGS-72.
MU, RE, J2, J3, J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RE**3 / MU)
TWO_PI = 2 * np.pi


def coded_sgp4(n_revs, ecc, incl, node, argp, mean, bstar, minutes):
    """Positions (km) and velocities (km/s) in the true equator frame, and codes; angles in degrees, all arguments arrays of one length.

    Codes: 0 is fine, 1 a period of 225 minutes or more (the deep-space terms aren't modelled), 2 elements out of range, 3 decayed. All but
    0 have no position.
    """
    no, e = np.asarray(n_revs, float) * TWO_PI / 1440, np.asarray(ecc, float)
    i0, node0, w0, m0 = (np.radians(np.asarray(x, float)) for x in (incl, node, argp, mean))
    bstar, t = np.asarray(bstar, float), np.asarray(minutes, float)
    ci, si = np.cos(i0), np.sin(i0)
    c2, c4 = ci * ci, ci**4
    one_e2 = 1 - e * e
    beta0 = np.sqrt(one_e2)
    # mean motion and semi-major axis without the secular oblateness that the elements hold
    a1 = (XKE / no) ** (2 / 3)
    d1 = 0.75 * J2 * (3 * c2 - 1) / (beta0 * one_e2)
    k = d1 / a1**2
    k = d1 / (a1 * (1 - k * k - k * (1 / 3 + 134 * k * k / 81))) ** 2
    no = no / (1 + k)
    ao = (XKE / no) ** (2 / 3)
    po = ao * one_e2
    three, five = 3 * c2 - 1, 1 - 5 * c2
    rp = ao * (1 - e)
    simple = rp < 220 / RE + 1
    # the drag model's reference height
    perigee = (rp - 1) * RE
    s4 = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
    q4 = ((120 - s4) / RE) ** 4
    s4 = s4 / RE + 1
    tsi = 1 / (ao - s4)
    eta = ao * e * tsi
    eta2, eeta = eta * eta, e * eta
    psi2 = np.abs(1 - eta2)
    coef = q4 * tsi**4
    coef1 = coef / psi2**3.5
    j32 = J3 / J2
    c_2 = coef1 * no * (ao * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * J2 * tsi / psi2 * three * (8 + 3 * eta2 * (8 + eta2)))
    c_1 = bstar * c_2
    round_ = e <= 1e-4
    safe_e = np.where(round_, 1.0, e)
    c_3 = np.where(round_, 0.0, -2 * coef * tsi * j32 * no * si / safe_e)
    x1 = 1 - c2
    c_4 = 2 * no * coef1 * ao * one_e2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * tsi / (ao * psi2) * (-3 * three * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * x1 * (2 * eta2 - eeta * (1 + eta2)) * np.cos(2 * w0)))
    c_5 = 2 * coef1 * ao * one_e2 * (1 + 2.75 * (eta2 + eeta) + eeta * eta2)
    # secular rates
    p2 = 1 / po**2
    f1 = 1.5 * J2 * p2 * no
    f2 = 0.5 * f1 * J2 * p2
    f3 = -0.46875 * J4 * p2 * p2 * no
    m_dot = no + 0.5 * f1 * beta0 * three + 0.0625 * f2 * beta0 * (13 - 78 * c2 + 137 * c4)
    w_dot = -0.5 * f1 * five + 0.0625 * f2 * (7 - 114 * c2 + 395 * c4) + f3 * (3 - 36 * c2 + 49 * c4)
    h_dot = -f1 * ci
    n_dot = h_dot + (0.5 * f2 * (4 - 19 * c2) + 2 * f3 * (3 - 7 * c2)) * ci
    w_cof = bstar * c_3 * np.cos(w0)
    m_cof = np.where(round_, 0.0, -(2 / 3) * coef * bstar / np.where(round_, 1.0, eeta))
    n_cof = 3.5 * one_e2 * h_dot * c_1
    l_cof = -0.25 * j32 * si * (3 + 5 * ci) / np.where(np.abs(1 + ci) > 1.5e-12, 1 + ci, 1.5e-12)
    y_cof = -0.5 * j32 * si
    d_2 = 4 * ao * tsi * c_1**2
    d_3 = (17 * ao + s4) * d_2 * tsi * c_1 / 3
    d_4 = 0.5 * d_2 * tsi * c_1 / 3 * ao * tsi * (221 * ao + 31 * s4) * c_1
    t3, t4 = d_2 + 2 * c_1**2, 0.25 * (3 * d_3 + c_1 * (12 * d_2 + 10 * c_1**2))
    t5 = 0.2 * (3 * d_4 + 12 * c_1 * d_3 + 6 * d_2**2 + 15 * c_1**2 * (2 * d_2 + c_1**2))
    # at the time asked for
    mdf, wdf = m0 + m_dot * t, w0 + w_dot * t
    om = node0 + n_dot * t + n_cof * t * t
    shift = np.where(simple, 0.0, w_cof * t + m_cof * ((1 + eta * np.cos(mdf)) ** 3 - (1 + eta * np.cos(m0)) ** 3))
    mm, w = mdf + shift, wdf - shift
    ta = 1 - c_1 * t - np.where(simple, 0.0, d_2 * t**2 + d_3 * t**3 + d_4 * t**4)
    te = bstar * c_4 * t + np.where(simple, 0.0, bstar * c_5 * (np.sin(mm) - np.sin(m0)))
    tl = 1.5 * c_1 * t * t + np.where(simple, 0.0, t3 * t**3 + t**4 * (t4 + t * t5))
    a = (XKE / no) ** (2 / 3) * ta**2
    nn = XKE / a**1.5
    ee = np.maximum(e - te, 1e-6)
    mm = mm + no * tl
    # long-period terms and Kepler's equation
    ax = ee * np.cos(w)
    inv = 1 / (a * (1 - ee * ee))
    ay = ee * np.sin(w) + inv * y_cof
    u = np.mod(mm + w + inv * l_cof * ax, TWO_PI)
    eo = u.copy() if isinstance(u, np.ndarray) else u
    for _ in range(10):
        step = (u - ay * np.cos(eo) + ax * np.sin(eo) - eo) / (1 - np.cos(eo) * ax - np.sin(eo) * ay)
        eo = eo + np.clip(step, -0.95, 0.95)
    ec, es = ax * np.cos(eo) + ay * np.sin(eo), ax * np.sin(eo) - ay * np.cos(eo)
    l2 = ax * ax + ay * ay
    pl = a * (1 - l2)
    r = a * (1 - ec)
    rd, rv = np.sqrt(a) * es / r, np.sqrt(pl) / r
    bl = np.sqrt(1 - l2)
    q = es / (1 + bl)
    su_, cu_ = a / r * (np.sin(eo) - ay - ax * q), a / r * (np.cos(eo) - ax + ay * q)
    su = np.arctan2(su_, cu_)
    s2, co2 = 2 * su_ * cu_, 1 - 2 * su_ * su_
    g1 = 0.5 * J2 / pl
    g2 = g1 / pl
    # short-period terms
    mr = r * (1 - 1.5 * g2 * bl * three) + 0.5 * g1 * x1 * co2
    su = su - 0.25 * g2 * (7 * c2 - 1) * s2
    xn = om + 1.5 * g2 * ci * s2
    xi = i0 + 1.5 * g2 * ci * si * co2
    mv = rd - nn * g1 * x1 * s2 / XKE
    rv = rv + nn * g1 * (x1 * co2 + 1.5 * three) / XKE
    mx, my = -np.sin(xn) * np.cos(xi), np.cos(xn) * np.cos(xi)
    ux, uy, uz = mx * np.sin(su) + np.cos(xn) * np.cos(su), my * np.sin(su) + np.sin(xn) * np.cos(su), np.sin(xi) * np.sin(su)
    vx, vy, vz = mx * np.cos(su) - np.cos(xn) * np.sin(su), my * np.cos(su) - np.sin(xn) * np.sin(su), np.sin(xi) * np.cos(su)
    speed = RE * XKE / 60
    pos, vel = np.stack([mr * RE * x for x in (ux, uy, uz)], -1), np.stack([(mv * x + rv * y) * speed for x, y in ((ux, vx), (uy, vy), (uz, vz))], -1)
    code = np.where(~np.isfinite(pos).all(-1) | ~(e < 1) | (e < 0) | (pl < 0) | ~(e - te < 1) | (e - te < -0.001) | (a < 0.95), 2, np.where(mr < 1, 3, 0))
    code = np.where(TWO_PI / no >= 225.0, 1, code)
    pos[code > 0], vel[code > 0] = np.nan, np.nan
    return pos, vel, code


def sgp4(*elements):
    """Positions and velocities of :func:`coded_sgp4`."""
    return coded_sgp4(*elements)[:2]


def sidereal_angle(jd):
    """Greenwich mean sidereal angle in radians (IAU 1982)."""
    t = (np.asarray(jd, float) - 2451545.0) / 36525
    s = 67310.54841 + (876600 * 3600 + 8640184.812866) * t + 0.093104 * t**2 - 6.2e-6 * t**3
    return np.mod(np.radians(s / 240), TWO_PI)


def to_earth_fixed(pos: np.ndarray, jd) -> np.ndarray:
    g = sidereal_angle(jd)
    c, s = np.cos(g), np.sin(g)
    return np.stack([pos[..., 0] * c + pos[..., 1] * s, -pos[..., 0] * s + pos[..., 1] * c, pos[..., 2]], -1)


def propagate(sats: DataFrame) -> DataFrame:
    """(sat, minutes, x, y, z, vx, vy, vz, code) for rows (sat, mean_motion, ecc, incl, node, argp, mean, bstar, minutes); null places where the code isn't 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                with np.errstate(all="ignore"):
                    p, v, code = coded_sgp4(*[b[c].to_numpy(float, na_value=np.nan) for c in ("mean_motion", "ecc", "incl", "node", "argp", "mean", "bstar", "minutes")])
                places = {n: pd.array(np.where(code > 0, 0, a), "Float64") for n, a in zip(("x", "y", "z", "vx", "vy", "vz"), (*p.T, *v.T), strict=True)}
                for a in places.values():
                    a[code > 0] = pd.NA
                yield pd.DataFrame({"sat": b["sat"], "minutes": b["minutes"], **places, "code": code.astype("int32")})

    return sats.mapInPandas(run, "sat long, minutes double, x double, y double, z double, vx double, vy double, vz double, code int")


def orbit_angles(states: DataFrame) -> DataFrame:
    """Adds ``raan`` and ``u`` (argument of latitude), degrees, to state vectors, as column expressions."""
    x, y, z, vx, vy, vz = (F.col(c) for c in ("x", "y", "z", "vx", "vy", "vz"))
    hx, hy, hz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
    h, n = F.sqrt(hx * hx + hy * hy + hz * hz), F.sqrt(hx * hx + hy * hy)
    nx, ny = -hy / n, hx / n
    ahead = (x * (-hz * ny) + y * (hz * nx) + z * (hx * ny - hy * nx)) / h
    around = lambda a: F.pmod(F.degrees(a) + 360, F.lit(360.0))
    return states.withColumn("raan", around(F.atan2(ny, nx))).withColumn("u", around(F.atan2(ahead, x * nx + y * ny)))


def shells(sats: DataFrame, gap_deg: float = 0.3, window_km: float = 6.0, least: int = 40) -> DataFrame:
    """(sat, band, shell): inclination bands split at gaps, then in each the densest altitude windows, one after the other."""
    # bands: one row for each hundredth of a degree is enough to see the gaps
    steps = sats.select(F.floor(F.col("incl") * 100).alias("c")).distinct()
    cuts = steps.withColumn("new", F.when(F.col("c") - F.lag("c").over(Window.orderBy("c")) > gap_deg * 100, 1).otherwise(0)).withColumn("band", F.sum("new").over(Window.orderBy("c"))).select("c", "band")

    def densest(df: pd.DataFrame) -> pd.DataFrame:
        left, out, k = df.sort_values(["alt", "sat"]), [], 0
        while len(left) >= least:
            a = left["alt"].to_numpy()
            n = np.searchsorted(a, a + 2 * window_km, "right") - np.arange(len(a))
            at = int(n.argmax())
            if n[at] < least:
                break
            out.append(left.iloc[at : at + n[at]].assign(shell=k))
            left, k = pd.concat([left.iloc[:at], left.iloc[at + n[at] :]]), k + 1
        return pd.concat(out)[["sat", "band", "shell"]] if out else pd.DataFrame({"sat": [], "band": [], "shell": []})

    banded = sats.withColumn("c", F.floor(F.col("incl") * 100)).join(F.broadcast(cuts), "c").select("sat", "band", "alt")
    return banded.groupBy("band").applyInPandas(densest, "sat long, band long, shell int")


def planes(states: DataFrame, shell: list[str], gap: float = 1.0, span: float = 1.6, least: int = 4) -> DataFrame:
    """(shell..., sat, plane, u): satellites of a shell by ascending node, cut on the circle at gaps and wide planes split at their widest gap."""
    kinds = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in shell)

    def cut(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["raan", "sat"]).reset_index(drop=True)
        r = df["raan"].to_numpy()
        wide = np.diff(np.r_[r, r[0] + 360])
        first = (int(wide.argmax()) + 1) % len(r)
        df = pd.concat([df.iloc[first:], df.iloc[:first]], ignore_index=True)
        r = np.unwrap(np.radians(df["raan"].to_numpy()))
        r = np.degrees(r)
        work = [x for x in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r) > gap) + 1)]
        out = []
        while work:
            g = work.pop(0)
            if len(g) > 1 and r[g[-1]] - r[g[0]] > span:
                at = int(np.diff(r[g]).argmax()) + 1
                work = [g[:at], g[at:], *work]
            elif len(g) >= least:
                out.append(df.iloc[g].sort_values("u").assign(plane=len(out)))
        return pd.concat(out)[[*shell, "sat", "plane", "u"]] if out else df.iloc[:0].assign(plane=0)[[*shell, "sat", "plane", "u"]]

    return states.groupBy(*shell).applyInPandas(cut, f"{kinds}, sat long, plane int, u double")


def ring_links(members: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a, b): each satellite with the next in its plane, the last with the first."""
    w = Window.partitionBy(*by).orderBy("u", "sat")
    n = F.count("*").over(Window.partitionBy(*by))
    m = members.withColumn("n", n).withColumn("k", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("sat").over(w), F.first("sat").over(w)))
    return m.where("n > 2 OR (n = 2 AND k = 1)").select(*by, F.col("sat").alias("a"), F.col("next").alias("b"))


def cross_links(members: DataFrame, by: list[str], most_km: float = 5000.0) -> DataFrame:
    """(by..., a, b, km): nearest satellites of neighbouring planes (column ``plane``, with x, y, z), matched greedily, the shortest first."""
    n = members.groupBy(*by).agg((F.max("plane") + 1).alias("planes"))
    m = members.join(n, by)
    own = m.withColumn("pair", F.col("plane")).withColumn("west", F.lit(True))
    other = m.withColumn("pair", F.pmod(F.col("plane") - 1, F.col("planes"))).withColumn("west", F.lit(False))
    sides = own.unionByName(other).where("planes > 2 OR (planes = 2 AND pair = 0)")
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in by)

    def match(df: pd.DataFrame) -> pd.DataFrame:
        p, q = df[df.west].reset_index(drop=True), df[~df.west].reset_index(drop=True)
        out = []
        if len(p) and len(q):
            d = np.linalg.norm(p[["x", "y", "z"]].to_numpy()[:, None] - q[["x", "y", "z"]].to_numpy()[None], axis=-1)
            i, j = np.r_[np.arange(len(p)), d.argmin(0)], np.r_[d.argmin(1), np.arange(len(q))]
            used_p, used_q = set(), set()
            for k in np.argsort(d[i, j], kind="stable"):
                if d[i[k], j[k]] <= most_km and i[k] not in used_p and j[k] not in used_q:
                    used_p.add(i[k])
                    used_q.add(j[k])
                    out.append((*[df[c].iloc[0] for c in by], int(p["sat"][i[k]]), int(q["sat"][j[k]]), float(d[i[k], j[k]])))
        return pd.DataFrame(out, columns=[*by, "a", "b", "km"])

    return sides.groupBy(*by, "pair").applyInPandas(match, f"{kinds}, a long, b long, km double")


def serving(options: DataFrame, point: str, laser_cost: str | None = None) -> DataFrame:
    """(point, sat, rule): the highest satellite in view that sees a gateway, else the cheapest by laser, else the highest."""
    cost = F.col(laser_cost) if laser_cost else F.lit(None).cast("double")
    rank = F.when(F.col("terminal"), F.struct(F.lit(0).alias("k"), (-F.col("elevation")).alias("v"))).when(cost.isNotNull(), F.struct(F.lit(1).alias("k"), cost.alias("v"))).otherwise(F.struct(F.lit(2).alias("k"), (-F.col("elevation")).alias("v")))
    best = options.groupBy(point).agg(F.min(F.struct(rank.alias("r"), "sat")).alias("b"))
    return best.select(point, F.col("b.sat").alias("sat"), F.element_at(F.array(F.lit("bent-pipe"), F.lit("laser"), F.lit("no-gateway")), F.col("b.r.k") + 1).alias("rule"))


def traffic(demand: DataFrame, served: DataFrame, exits: DataFrame, point: str) -> DataFrame:
    """(gateway, load, share): demand of each point carried to the gateway that its satellite goes down at."""
    load = demand.join(served, point).join(exits, "sat").groupBy("gateway").agg(F.sum("weight").alias("load"))
    total = F.broadcast(demand.agg(F.sum("weight").alias("total")))
    return load.crossJoin(total).select("gateway", "load", (F.col("load") / F.col("total")).alias("share"))
