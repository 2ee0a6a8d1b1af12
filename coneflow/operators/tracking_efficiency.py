"""Tracking efficiency by period, event activity, pt and eta as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kinematics import gaussian

# Published efficiency fits. Classes of event activity run from central to peripheral.
#: pp at 2.76 TeV: powers 1 to 6 of pt, the plateau from 6 GeV, powers 1 to 4 of |eta|.
PP_PT = (-0.442232, 0.501831, -0.252024, 0.062964, -0.007681, 0.000365)
PP_PLATEAU = 0.898052
PP_ETA = (0.402825, -2.213152, 4.311098, -2.778200)
#: Heavy ions, first run.
RUN1 = (
    (0.971679, 0.0767571, 1.13355, -0.0274484, 0.856652, 0.00536795, 3.90795e-05, 1.06889, 0.011007, 0.447046, -0.146626, 0.919777, 0.192601, -0.268515, 1.00243, 0.00620849, 0.709477),
    (0.97929, 0.0776039, 1.12213, -0.0300645, 0.844722, 0.0134788, -0.0012333, 1.07955, 0.0116835, 0.456608, -0.132743, 0.930964, 0.174175, -0.267154, 0.993118, 0.00574892, 0.765256),
    (0.997696, 0.0816769, 1.14341, -0.0353734, 0.752151, 0.0744259, -0.0102926, 1.01561, 0.00713274, 0.57203, -0.0640248, 0.947747, 0.102007, -0.194698, 0.999164, 0.00568476, 0.7237),
    (0.97041, 0.0813559, 1.12151, -0.0368797, 0.709327, 0.0701501, -0.00784043, 1.06276, 0.00676173, 0.53607, -0.0703117, 0.982534, 0.0947881, -0.18073, 1.03229, 0.00580109, 0.737801),
)
#: Heavy ions, second run: five values below and five above 3.5 GeV; six values each side of eta -0.04 and a norm.
RUN2_PT = (
    (0.8350, 0.0621, 0.0986, 0.2000, 1.0124, 0.7568, 0.0277, -0.0034, 0.0001506, -0.0000023),
    (0.8213, 0.0527, 0.0867, 0.1970, 1.1518, 0.7469, 0.0300, -0.0038, 0.0001704, -0.0000026),
    (0.8381, 0.0648, 0.1052, 0.1478, 1.0320, 0.7628, 0.0263, -0.0032, 0.0001443, -0.0000023),
    (0.8437, 0.0668, 0.1083, 0.2000, 0.9741, 0.7677, 0.0255, -0.0030, 0.0001260, -0.0000019),
)
RUN2_ETA = (
    (1.0086, 0.0074, 0.2404, -0.1230, -0.0107, 0.0427, 0.8579, 0.0088, 0.4697, 0.0772, -0.0352, 0.0645, 0.7716),
    (0.9726, 0.0066, 0.2543, -0.1167, -0.0113, 0.0400, 0.8729, 0.0122, 0.4537, 0.0965, -0.0328, 0.0623, 0.7658),
    (0.9076, 0.0065, 0.3216, -0.1130, -0.0107, 0.0456, 0.8521, 0.0073, 0.4764, 0.0668, -0.0363, 0.0668, 0.7748),
    (1.1259, 0.0105, 0.1961, -0.1330, -0.0103, 0.0440, 0.8421, 0.0066, 0.5061, 0.0580, -0.0379, 0.0651, 0.7786),
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """c0 + c1 x + c2 x^2 + ..., by Horner's rule."""
    return reduce(lambda out, c: out * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _saturating(height: float, place: float, power: float, x: Column) -> Column:
    return height * F.exp(-F.pow(place / x, F.lit(power)))


def _run1(pt: Column, eta: Column, p: tuple[float, ...]) -> Column:
    in_pt = F.when(pt < 2.9, _saturating(*p[0:3], pt) + p[3] * pt).otherwise(polynomial(pt, p[4:7]))
    left = _saturating(*p[7:10], F.abs(eta + 0.91)) + p[10] * eta
    return in_pt * F.when(eta < 0, left).when(eta <= 0.4, polynomial(eta, p[11:14])).otherwise(_saturating(*p[14:17], F.abs(0.91 - eta)))


def _run2(pt: Column, eta: Column, p: tuple[float, ...], q: tuple[float, ...]) -> Column:
    in_pt = F.when(pt <= 3.5, p[0] - p[1] / pt + p[2] * gaussian(pt, p[3], p[4])).otherwise(polynomial(pt, p[5:10]))

    def side(v: tuple[float, ...], sign: int) -> Column:
        return (_saturating(*v[0:3], F.abs(sign * eta + 0.91)) + v[3] * eta + v[4] * gaussian(eta, -0.04, v[5])) / q[12]

    return in_pt * F.when(eta <= -0.04, side(q[0:6], 1)).otherwise(side(q[6:12], -1))


def efficiency(pt: Column, eta: Column, period: str, activity: Column | None = None) -> Column:
    """Chance to measure a track; null where a heavy-ion event has no activity class.

    Periods: disabled (1 everywhere), LHC11a (pp, no activity), LHC11h, LHC15o.
    """
    if period == "disabled":
        return F.lit(1.0)
    if period == "LHC11a":
        if activity is not None:
            raise ValueError("the pp period has no event activity")
        return F.when(pt < 6, polynomial(pt, (1.0, *PP_PT))).otherwise(PP_PLATEAU) * polynomial(F.abs(eta), (1.0, *PP_ETA))
    if period not in ("LHC11h", "LHC15o") or activity is None:
        raise ValueError(f"no tracking efficiency for period {period!r} with this activity")
    by_class = [_run1(pt, eta, p) for p in RUN1] if period == "LHC11h" else [_run2(pt, eta, p, q) for p, q in zip(RUN2_PT, RUN2_ETA)]
    out = F.when(activity == 0, by_class[0])
    for k in (1, 2, 3):
        out = out.when(activity == k, by_class[k])
    return out
