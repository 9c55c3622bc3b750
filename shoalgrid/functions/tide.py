"""Harmonic tide model as Column expressions: 23 constituents with nodal corrections, unrolled so that they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean level (m) and, by constituent, speed (radians an hour), amplitude (m) and phase (radians); hours count from 2023-01-01 UTC.
MEAN_LEVEL = 1.0540609877941658
CONSTITUENTS = (
    ("M2", 0.5058680455404585, 0.6552741298331658, 1.1297598754302625),
    ("S2", 0.5235987755982988, 0.10584599010802048, -1.736349998664027),
    ("N2", 0.49636692687820694, 0.16657539001542884, 2.3114191625025593),
    ("K2", 0.5250323366860095, 0.019976446339386857, 1.0724887071596791),
    ("K1", 0.26251617706965097, 0.052850016091018616, -0.25497719722399614),
    ("O1", 0.24335186847080756, 0.020922609656975684, -2.6073115508241624),
    ("P1", 0.2610825985286479, 0.016849597011402734, 0.14308503380606707),
    ("M4", 1.011736091080917, 0.06202110172262469, 1.8674877801998344),
    ("MS4", 1.0294668211387574, 0.006410458812507479, -1.2941095613608067),
    ("MN4", 1.0022349375120805, 0.010238216005212906, 3.0733538462873073),
    ("Mm", 0.009501136115544132, 0.02122478802805712, 1.5598071778113904),
    ("2N2", 0.4868657907626628, 0.015732213591737272, -2.828770510311402),
    ("MU2", 0.48813731548261824, 0.004584518119756976, 0.5874796647700493),
    ("NU2", 0.49763845159816233, 0.0430704203558179, 3.018711522523577),
    ("L2", 0.5153691816560027, 0.05131553199608894, 2.4240039914847222),
    ("T2", 0.5228820212343823, 0.007397787796435036, -0.9050202951174641),
    ("LDA2", 0.5140976394827548, 0.024487165018789125, 1.8726415536787289),
    ("J1", 0.2720172957319026, 0.005638390248776675, -1.1956686768499358),
    ("M6", 1.5176041366213757, 0.06629334252854092, -3.117395852923498),
    ("2MS6", 1.5353348666792161, 0.02083695688162504, 1.844935959991826),
    ("MK3", 0.7683842226101095, 0.00938298908035815, 1.255582226441998),
    ("MSF", 0.017730730057840313, 0.008274410648431615, 0.6068961366376181),
    ("SA", 0.0007167892705015512, 0.044370243342402686, 1.88286173121287),
)
#: Nodal series of the basic constituents. Amplitude factor: terms of 1, cos N, cos 2N, cos 3N; phase (degrees): terms of sin N, sin 2N, sin 3N.
NODAL = {
    "M2": ((1.0, -0.037), (-2.14,)),
    "K1": ((1.0060, 0.1150, -0.0088, 0.0006), (-8.86, 0.68, -0.07)),
    "O1": ((1.0089, 0.1871, -0.0147, 0.0014), (10.80, -1.34, 0.19)),
    "K2": ((1.0246, 0.2863, 0.0083, -0.0015), (-17.74, 0.68, -0.04)),
    "J1": ((1.0129, 0.1676, -0.0170, 0.0016), (-12.94, 1.34, -0.19)),
    "OO1": ((1.1027, 0.6504, 0.0317), (-36.68, 2.72)),
    "Mm": ((1.0, -0.130, 0.0013), ()),
    "Mf": ((1.0429, 0.4135, -0.004), (-23.74, 2.68, -0.38)),
}
#: Which basic constituents' factors multiply (and phases add, with the sign given) for each; solar ones have none.
NODAL_OF = {
    **{c: (("M2", 1, 1),) for c in ("M2", "N2", "MS4", "2N2", "MU2", "NU2", "L2", "LDA2")},
    **{c: ((c, 1, 1),) for c in ("K1", "O1", "K2", "J1", "Mm")},
    **{c: (("M2", 2, 2),) for c in ("M4", "MN4", "2MS6")},
    "M6": (("M2", 3, 3),),
    "MK3": (("M2", 1, 1), ("K1", 1, 1)),
    "MSF": (("M2", 1, -1),),
}
#: The same for species that the model leaves out but a fit may hold; those not named here or above have none.
NODAL_OF_OTHERS = {**{c: (("O1", 1, 1),) for c in ("Q1", "M1", "RHO1", "SIGMA1")}, "OO1": (("OO1", 1, 1),), "Mf": (("Mf", 1, 1),), "SSA": (), "S4": (), "S2": (), "P1": (), "T2": (), "SA": ()}
#: The constituents of a fit and their speeds (degrees an hour); hours count from 2025-01-01 UTC.
FITTED = (
    ("M2", 28.9841042), ("S2", 30.0), ("N2", 28.4397295), ("K2", 30.0821373), ("K1", 15.0410686), ("O1", 13.9430356), ("P1", 14.9589314), ("Q1", 13.3986609), ("2N2", 27.8953548), ("MU2", 27.9682084),
    ("NU2", 28.5125831), ("L2", 29.5284789), ("T2", 29.9589333), ("S1", 15.0), ("J1", 15.5854433), ("M1", 14.4966939), ("OO1", 16.1391017), ("MF", 1.0980331), ("MM", 0.5443747), ("SSA", 0.0821373),
    ("SA", 0.0410686), ("MSF", 1.0158958), ("M4", 57.9682084), ("MS4", 58.9841042), ("MN4", 57.4238337), ("M6", 86.9523127), ("2MS6", 87.9682084), ("S4", 60.0), ("MK3", 44.0251729), ("M3", 43.4761563),
)
#: Hours from the model's epoch to the fit's.
FIT_EPOCH = 731 * 24.0
#: Days from 2000-01-01 12:00 UTC to the epoch.
_NODE_DAYS = 8400.5


def epoch_hours(ts: Column) -> Column:
    """Hours since 2023-01-01 of a timestamp that is in UTC as it reads, whatever the session's zone."""
    return (F.date_diff(ts.cast("date"), F.lit("2023-01-01").cast("date")) * 24 + F.hour(ts)).cast("double") + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0)


def node_angle(hours: Column) -> Column:
    """Mean longitude of the Moon's ascending node, in radians."""
    return (F.lit(125.04452) - F.lit(1934.136261 / 36525) * (F.lit(_NODE_DAYS) + hours / F.lit(24.0))) * F.lit(math.pi / 180)


def nodal_factor(name: str, n: Column) -> Column:
    out = F.lit(NODAL[name][0][0])
    for k, c in enumerate(NODAL[name][0][1:], 1):
        out = out + F.lit(c) * F.cos(n * F.lit(float(k)))
    return out


def nodal_phase(name: str, n: Column) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(NODAL[name][1], 1):
        out = out + F.lit(c) * F.sin(n * F.lit(float(k)))
    return out * F.lit(math.pi / 180)


def species(name: str, n: Column) -> tuple[Column, Column]:
    """(factor, phase) of any species."""
    size, angle = F.lit(1.0), F.lit(0.0)
    for basic, power, times in (NODAL_OF | NODAL_OF_OTHERS)[name]:
        for _ in range(power):
            size = size * nodal_factor(basic, n)
        angle = angle + F.lit(float(times)) * nodal_phase(basic, n)
    return size, angle


def _terms(hours: Column, nodal: bool = True):
    n = node_angle(hours)
    for name, speed, amplitude, phase in CONSTITUENTS:
        size, angle = F.lit(amplitude), F.lit(speed) * hours - F.lit(phase)
        for basic, power, times in NODAL_OF.get(name, ()) if nodal else ():
            for _ in range(power):
                size = size * nodal_factor(basic, n)
            if NODAL[basic][1]:
                angle = angle - F.lit(float(times)) * nodal_phase(basic, n)
        yield speed, size, angle


def height(hours: Column, nodal: bool = True) -> Column:
    """Metres above chart datum."""
    out = F.lit(MEAN_LEVEL)
    for _, size, angle in _terms(hours, nodal):
        out = out + size * F.cos(angle)
    return out


def slope(hours: Column) -> Column:
    """Metres an hour, with the nodal terms held fixed."""
    out = F.lit(0.0)
    for speed, size, angle in _terms(hours):
        out = out - size * F.lit(speed) * F.sin(angle)
    return out


def cosine_between(before: Column, after: Column, share: Column) -> Column:
    """Half a cosine from one turning point to the next."""
    return before + (after - before) * (F.lit(1.0) - F.cos(share * F.lit(math.pi))) / F.lit(2.0)


def season(day_of_year: Column) -> Column:
    """1 at the southern summer solstice; day_of_year counts from 0."""
    return F.cos((day_of_year - 355) * F.lit(2 * math.pi / 365.25))


#: Range of the water levels that a view shows.
LOWEST, HIGHEST = 0.332, 2.127


def state_word(h: Column, rising: Column) -> Column:
    f = (h - F.lit(LOWEST)) / F.lit(HIGHEST - LOWEST)
    return F.when(f < 0.14, "Low Tide").when(f > 0.86, "High Tide").when((f > 0.40) & (f < 0.60), "Mid Tide").when(rising, "Flooding").otherwise("Draining")


def civil_offset(local: Column) -> Column:
    """Hours ahead of UTC of New Zealand's civil time: 13 from the last Sunday of September 02:00 to the first of April 03:00, else 12."""
    year = F.year(local)
    first = F.make_date(year, F.lit(4), F.lit(1))
    april = F.date_add(first, F.pmod(F.lit(8) - F.dayofweek(first), F.lit(7)))
    last = F.make_date(year, F.lit(9), F.lit(30))
    september = F.date_sub(last, F.pmod(F.dayofweek(last) - 1, F.lit(7)))
    day, hour = local.cast("date"), F.hour(local)
    before = (day < april) | ((day == april) & (hour < 3))
    after = (day > september) | ((day == september) & (hour >= 2))
    return F.when(before | after, 13).otherwise(12)
