"""Scalar functions as Column expressions: special functions, times, units, phases and amplitudes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published constants (SI).
C, G, KPC, OBLIQUITY = 299792458.0, 6.6743e-11, 3.0856775814913673e19, math.radians(84381.4059 / 3600)
MOMENT_OF_INERTIA = 1e38
Q22_FACTOR = MOMENT_OF_INERTIA * math.sqrt(15 / (8 * math.pi))
SIDEREAL_DAY = 86164.0905
GPS_EPOCH_UNIX, TT_MINUS_GPS, GPS_EPOCH_MJD = 315964800, 51.184, 44244.0
#: Unix times from which UTC lags GPS by one second more (fixed values, published leap seconds since 1980).
LEAPS = [
    362793600, 394329600, 425865600, 489024000, 567993600, 631152000, 662688000, 709948800, 741484800,
    773020800, 820454400, 867715200, 915148800, 1136073600, 1230768000, 1341100800, 1435708800, 1483228800,
]
#: SI factors of parameter-file units (fixed values).
SI_FACTORS = {
    "DIST": KPC, "PB": 86400.0, "PMRA": math.pi / 180 / 3600e3 / 31557600.0, "PMDEC": math.pi / 180 / 3600e3 / 31557600.0,
    "PX": math.pi / 180 / 3600e3, "OM": math.pi / 180, "OMDOT": math.pi / 180 / 31557600.0, "GLTD": 86400.0,
}
RESCALED = ["XDOT", "PBDOT", "EPS1DOT", "EPS2DOT", "XPBDOT"]
EPOCHS = ["PEPOCH", "POSEPOCH", "DMEPOCH", "T0", "TASC", "GLEP"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ln_gamma(x) -> Column:
    """ln of gamma for x > 0: Stirling's series ten further on."""
    x = col(x).cast("double")
    z = x + 10
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return series - F.log(product)


def ln_factorial(n) -> Column:
    return ln_gamma(col(n) + 1)


def erfc(x) -> Column:
    """Complementary error function, fractional error below 1.2e-7 (a published Chebyshev fit)."""
    x = col(x)
    t = 1 / (1 + 0.5 * F.abs(x))
    fit = F.lit(0.17087277)
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        fit = F.lit(a) + t * fit
    y = t * F.exp(-x * x - 1.26551223 + t * fit)
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_cdf(z) -> Column:
    return 0.5 * erfc(-col(z) / math.sqrt(2))


def log_add(a, b) -> Column:
    """ln(exp(a) + exp(b))."""
    hi, lo = F.greatest(col(a), col(b)), F.least(col(a), col(b))
    return hi + F.log1p(F.exp(lo - hi))


def ellipticity_to_q22(e) -> Column:
    return col(e) * Q22_FACTOR


def q22_to_ellipticity(q) -> Column:
    return col(q) / Q22_FACTOR


def h0_to_ellipticity(h0, f, d) -> Column:
    """f: rotation frequency, d: distance in metres; null unless the distance is known."""
    return col(h0) * C**4 * col(d) / (16 * math.pi**2 * G * MOMENT_OF_INERTIA * col(f) * col(f))


def h0_to_q22(h0, f, d) -> Column:
    return ellipticity_to_q22(h0_to_ellipticity(h0, f, d))


def h0_spindown(f, fdot, d) -> Column:
    """Spin-down limit; null unless the frequency falls."""
    f, fdot = col(f), col(fdot)
    return F.when(fdot < 0, F.sqrt(-5 * G * MOMENT_OF_INERTIA * fdot / (2 * C**3 * f)) / col(d))


def source_name(*names) -> Column:
    """First non-null name."""
    return F.coalesce(*[col(n) for n in names])


def unix_to_gps(t) -> Column:
    """UTC Unix seconds to GPS seconds."""
    t = col(t)
    leaps = sum((F.when(t >= x, 1).otherwise(0) for x in LEAPS), F.lit(0))
    return t - GPS_EPOCH_UNIX + leaps


def gps_to_unix(t) -> Column:
    """GPS seconds to UTC Unix seconds."""
    t = col(t)
    leaps = sum((F.when(t >= x - GPS_EPOCH_UNIX + n + 1, 1).otherwise(0) for n, x in enumerate(LEAPS)), F.lit(0))
    return t + GPS_EPOCH_UNIX - leaps


def to_gps(iso) -> Column:
    """ISO string, timestamp or GPS number to GPS seconds."""
    c = col(iso).cast("string")
    return F.coalesce(c.try_cast("double"), unix_to_gps(F.unix_seconds(F.to_timestamp(c))).cast("double"))


def gps_to_iso(t) -> Column:
    return F.date_format(F.timestamp_seconds(gps_to_unix(t)), "yyyy-MM-dd'T'HH:mm:ss")


def mjd_to_gps(mjd, scale: str = "tt") -> Column:
    """Modified Julian date to GPS seconds; scale tt (parameter epochs) or utc (run tables)."""
    seconds = (col(mjd) - GPS_EPOCH_MJD) * 86400
    return seconds - TT_MINUS_GPS if scale == "tt" else unix_to_gps(seconds + GPS_EPOCH_UNIX)


def gps_to_mjd(t, scale: str = "tt") -> Column:
    t = col(t)
    return ((t + TT_MINUS_GPS) if scale == "tt" else gps_to_unix(t) - GPS_EPOCH_UNIX) / 86400 + GPS_EPOCH_MJD


def sexagesimal_to_rad(s, hours: bool) -> Column:
    """hh:mm:ss or dd:mm:ss (sign kept, also of -00) to radians."""
    p = F.split(F.ltrim(col(s)), ":")
    part = lambda i: F.coalesce(F.abs(F.get(p, F.lit(i)).try_cast("double")), F.lit(0.0))
    sign = F.when(F.get(p, F.lit(0)).startswith("-"), -1.0).otherwise(1.0)
    return sign * (part(0) + part(1) / 60 + part(2) / 3600) * (math.pi / 12 if hours else math.pi / 180)


def to_si(key, value) -> Column:
    """A parameter's value in SI by its key: positions, epochs, unit factors and the rescaled derivatives."""
    key, number = col(key), col(value).try_cast("double")
    out = F.when(key.isin("RA", "RAJ"), sexagesimal_to_rad(value, True)).when(key.isin("DEC", "DECJ"), sexagesimal_to_rad(value, False))
    out = out.when(key.isin(*EPOCHS), mjd_to_gps(number))
    for k, f in SI_FACTORS.items():
        out = out.when(key == k, number * f)
    small = F.abs(number) / 1e-12 > 1e-7
    return out.when(key.isin(*RESCALED), F.when(small, number * 1e-12).otherwise(number)).otherwise(number)


def from_si(key, value) -> Column:
    """The numeric inverse of :func:`to_si` for unit factors and epochs."""
    key, value = col(key), col(value)
    out = F.when(key.isin(*EPOCHS), gps_to_mjd(value))
    for k, f in SI_FACTORS.items():
        out = out.when(key == k, value / f)
    return out.otherwise(value)


def ecliptic_to_equatorial(lon, lat, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    lon, lat = col(lon), col(lat)
    ce, se = math.cos(obliquity), math.sin(obliquity)
    x, y, z = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    return F.pmod(F.atan2(y * ce - z * se, x), F.lit(2 * math.pi)), F.asin(y * se + z * ce)


def equatorial_to_ecliptic(ra, dec, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    return ecliptic_to_equatorial(ra, dec, -obliquity)


def angular_separation(ra1, dec1, ra2, dec2) -> Column:
    ra1, dec1, ra2, dec2 = map(col, (ra1, dec1, ra2, dec2))
    h = F.pow(F.sin((dec2 - dec1) / 2), 2) + F.cos(dec1) * F.cos(dec2) * F.pow(F.sin((ra2 - ra1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def complex_rotate(re, im, cycles) -> tuple[Column, Column]:
    """(re + i im) * exp(-2 pi i cycles); cycles are reduced to a fraction first."""
    re, im, c = col(re), col(im), col(cycles)
    a = (c - F.floor(c)) * (2 * math.pi)
    return re * F.cos(a) + im * F.sin(a), im * F.cos(a) - re * F.sin(a)


def phase_cycles(t, f: list, epoch, delay=None, factor=1.0) -> Column:
    """factor * sum_n f_n (t + delay - epoch)^(n+1) / (n+1)!, reduced to fractions term by term.

    Whole seconds and the fraction are multiplied apart, which keeps 1e-7 of a cycle over years.
    """
    t, epoch = col(t), col(epoch)
    whole = F.floor(t - epoch)
    frac = (t - epoch) - whole + (col(delay) if delay is not None else F.lit(0.0))
    total, dt = F.lit(0.0), whole + frac
    for n, fn in enumerate(f):
        fn = col(fn) * factor
        if n == 0:
            hz = F.floor(fn)
            part = F.pmod((fn - hz) * whole, F.lit(1.0)) + fn * frac
        else:
            part = fn * F.pow(dt, F.lit(n + 1)) / math.factorial(n + 1)
        total = total + (part - F.floor(part))
    return total - F.floor(total)


#: Unit vectors along the arms (published site values).
ARMS = {
    "H1": ((-0.22389266154, 0.79983062746, 0.55690487831), (-0.91397818574, 0.02609403989, -0.40492342125)),
    "L1": ((-0.95457412153, -0.14158077340, -0.26218911324), (0.29774156894, -0.48791033647, -0.82054461286)),
    "V1": ((-0.70045821479, 0.20848948619, 0.68256166277), (-0.05379255368, -0.96908180549, 0.24080451708)),
}


def antenna_pattern(sidereal, ra, dec, detector: str, psi=0.0) -> tuple[Column, Column]:
    """(F+, Fx) at a sidereal angle by the contraction of the detector's tensor with the wave's."""
    x, y = ARMS[detector]
    d = [[0.5 * (x[i] * x[j] - y[i] * y[j]) for j in range(3)] for i in range(3)]
    g, dec, psi = col(sidereal) - col(ra), col(dec), F.lit(psi) if isinstance(psi, float) else col(psi)
    sp, cp, sg, cg, sd, cd = F.sin(psi), F.cos(psi), F.sin(g), F.cos(g), F.sin(dec), F.cos(dec)
    u = [-cp * sg - sp * cg * sd, -cp * cg + sp * sg * sd, sp * cd]
    v = [sp * sg - cp * cg * sd, sp * cg + cp * sg * sd, cp * cd]
    plus = sum((F.lit(d[i][j]) * (u[i] * u[j] - v[i] * v[j]) for i in range(3) for j in range(3)), F.lit(0.0))
    cross = sum((F.lit(d[i][j]) * (u[i] * v[j] + v[i] * u[j]) for i in range(3) for j in range(3)), F.lit(0.0))
    return plus, cross


def amplitude(c21, c22, cosiota, phi21, phi22, harmonic: int) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """((re, im) of F+'s coefficient, (re, im) of Fx's) at 1f or 2f."""
    ci = col(cosiota)
    if harmonic == 2:
        phi, plus, cross = col(phi22), -0.5 * col(c22) * (1 + ci * ci), col(c22) * ci
    else:
        si = F.sqrt(1 - ci * ci)
        phi, plus, cross = col(phi21), -0.25 * col(c21) * si * ci, 0.25 * col(c21) * si
    return (plus * F.cos(phi), plus * F.sin(phi)), (-cross * F.sin(phi), cross * F.cos(phi))


def mode_amplitudes(plus, cross, x, y, breathing, longitudinal, phases) -> dict[str, tuple[Column, Column]]:
    """(re, im) of the coefficients of the six responses for a source with tensor, vector and scalar modes.

    Each is half its amplitude times exp(i phase); ``phases`` are six in the order of the amplitudes. An absent (null) amplitude or phase is 0.
    """
    zero = lambda c: F.coalesce(col(c), F.lit(0.0))
    names, values = ("tp", "tc", "vx", "vy", "sb", "sl"), (plus, cross, x, y, breathing, longitudinal)
    return {n: (0.5 * zero(h) * F.cos(zero(p)), 0.5 * zero(h) * F.sin(zero(p))) for n, h, p in zip(names, values, phases, strict=True)}


def log_base(x, base_from: float, base_to: float) -> Column:
    return col(x) * (math.log(base_from) / math.log(base_to))


def component(re, im, which: str) -> Column:
    return {"abs": F.hypot(col(re), col(im)), "real": col(re), "imag": col(im)}[which]


def asd_to_sigma(asd, dt) -> Column:
    return 0.5 * col(asd) / F.sqrt(col(dt))


def hash_uniform(n, seed: int = 0) -> Column:
    """A reproducible uniform number in [0, 1) for an integer, which counts modulo 2^31."""
    return F.pmod(F.pmod(col(n).cast("long"), F.lit(2147483648)) * 2654435761 + seed * 40503, F.lit(4294967296)) / 4294967296.0


def valid_source_name(name, allowed: tuple[str, ...] = ()) -> Column:
    """[BJ]hhmm[+-]dd with hhmm below 2400 and dd up to 90, or an allowed word inside."""
    name = col(name)
    m = r"^[BJ](\d{4})[+-](\d{2})"
    ok = name.rlike(m) & (F.regexp_extract(name, m, 1).try_cast("int") < 2400) & (F.regexp_extract(name, m, 2).try_cast("int") <= 90)
    for w in allowed:
        ok = ok | F.contains(F.lower(name), F.lit(w.lower()))
    return F.coalesce(ok, F.lit(False))
