"""The standard normal distribution as column expressions.

The quantile is Wichura's algorithm AS 241 (1988), the distribution function Cody's
rational approximations of erf (1969): both to about 1e-15, in plain arithmetic that stays
in whole-stage codegen.  A polynomial is a list of coefficients, highest power first."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from postlytics.functions._util import as_col

# AS 241, numerator and denominator for the middle, the tails and the far tails.
QUANTILE_MIDDLE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0])
QUANTILE_TAIL = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0])
QUANTILE_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0])
# Cody's erf for |x| <= 0.46875, erfc up to 4 and beyond.
ERF_SMALL = (
    [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
ERFC_MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3])
ERFC_FAR = (
    [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4],
    [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
     2.33520497626869185e-3])


def _ratio(pair: tuple[list[float], list[float]], x: Column) -> Column:
    above, below = (F.lit(c[0]) for c in pair)
    for a in pair[0][1:]:
        above = above * x + a
    for b in pair[1][1:]:
        below = below * x + b
    return above / below


def normal_quantile(p) -> Column:
    """The standard normal quantile of ``p``; null outside (0, 1)."""
    p = as_col(p).cast("double")
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(QUANTILE_TAIL, r - 1.6)).otherwise(_ratio(QUANTILE_FAR, r - 5.0))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(QUANTILE_MIDDLE, 0.180625 - q * q))
                  .otherwise(F.signum(q) * tail))


def normal_cdf(z) -> Column:
    """The standard normal distribution function of ``z``."""
    x = as_col(z).cast("double") / math.sqrt(2)
    y = F.abs(x)
    inverse = 1 / (x * x)
    far = (1 / math.sqrt(math.pi) - inverse * _ratio(ERFC_FAR, inverse)) / y
    upper = F.exp(-x * x) * F.when(y <= 4, _ratio(ERFC_MIDDLE, y)).otherwise(far) / 2
    return (F.when(y <= 0.46875, 0.5 + x * _ratio(ERF_SMALL, x * x) / 2)
            .when(x > 0, 1 - upper).otherwise(upper))
