"""Distribution functions, in Arrow batches; arguments outside the domain give missing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..stats import dists
from ..values import col
from . import function
from .maths import batch


def _arg(x) -> Column:
    return col(x) if isinstance(x, (str, Column)) else F.lit(float(x))


function("PROBNORM")(lambda x: batch(dists.norm_cdf, _arg(x), many=dists.norm_cdf_many))
function("PROBT")(lambda x, df: batch(dists.t_cdf, _arg(x), _arg(df), many=dists.t_cdf_many))
function("PROBF")(lambda x, a, b: batch(dists.f_cdf, _arg(x), _arg(a), _arg(b), many=dists.f_cdf_many))
function("PROBCHI")(lambda x, df: batch(dists.chi_cdf, _arg(x), _arg(df), many=lambda v, n: dists.gamma_p_many(n / 2, v / 2)))
function("PROBBETA")(lambda x, a, b: batch(lambda v, p, q: dists.beta_i(p, q, v), _arg(x), _arg(a), _arg(b), many=lambda v, p, q: dists.beta_i_many(p, q, v)))
function("PROBGAM")(lambda x, a: batch(lambda v, p: dists.gamma_p(p, v), _arg(x), _arg(a), many=lambda v, p: dists.gamma_p_many(p, v)))
function("PROBBNML")(lambda p, n, m: batch(dists.binom_cdf, _arg(p), _arg(n), _arg(m), many=dists.binom_cdf_many))
function("POISSON")(lambda m, n: batch(dists.poisson_cdf, _arg(m), _arg(n), many=dists.poisson_cdf_many))
function("CDF")(lambda dist, x, *q: batch(lambda v, *p: dists.cdf(dist, v, *p), _arg(x), *map(_arg, q), many=lambda v, *p: dists.cdf_many(dist, v, *p)))
function("PDF")(lambda dist, x, *q: batch(lambda v, *p: dists.pdf(dist, v, *p), _arg(x), *map(_arg, q)))
function("SDF")(lambda dist, x, *q: batch(lambda v, *p: 1 - dists.cdf(dist, v, *p), _arg(x), *map(_arg, q), many=lambda v, *p: 1 - dists.cdf_many(dist, v, *p)))
function("LOGCDF")(lambda dist, x, *q: batch(lambda v, *p: math.log(dists.cdf(dist, v, *p)), _arg(x), *map(_arg, q), many=lambda v, *p: np.log(dists.cdf_many(dist, v, *p))))
function("QUANTILE")(lambda dist, p, *q: batch(lambda v, *r: dists.quantile(dist, v, *r), _arg(p), *map(_arg, q), many=lambda v, *r: dists.quantile_many(dist, v, *r)))

# Coefficients of the rational approximation of the inverse normal distribution (Wichura, AS 241, PPND16).
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly(c: tuple, x: Column) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * x + F.lit(k)
    return out


@function("PROBIT")
def probit(p) -> Column:
    """Inverse standard normal distribution as one expression, without Python on the executors."""
    p = col(p)
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    center = q * _poly(_A, r0) / _poly(_B, r0)
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, far = tail - 1.6, tail - 5.0
    out = F.when(tail <= 5, _poly(_C, near) / _poly(_D, near)).otherwise(_poly(_E, far) / _poly(_F, far))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, center).otherwise(F.signum(q) * out))
