"""Normal distribution functions as Column expressions; Spark SQL has none built in.

``normal_cdf`` follows Hart's rational approximation of the complementary
function as G. West published it (2005), with an absolute error near 1e-15;
``normal_ppf`` is Wichura's algorithm AS 241, with a relative error near 1e-16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients, highest power first.
_HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_AS_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_AS_B = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_AS_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_AS_D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_AS_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_AS_F = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def polynomial(x: Column, coefficients) -> Column:
    """Horner's scheme, highest power first."""
    acc = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) * F.lit(0.3989422804014327)


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    near = F.exp(-a * a / 2) * polynomial(a, _HART_P) / polynomial(a, _HART_Q)
    tail = a + 0.65
    for k in (4, 3, 2, 1):
        tail = a + F.lit(float(k)) / tail
    far = F.exp(-a * a / 2) / tail / 2.506628274631
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def normal_ppf(p: Column) -> Column:
    """Quantile; null outside (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    middle = q * polynomial(r, _AS_A) / polynomial(r, _AS_B)
    s = F.sqrt(-F.log(F.when((p > 0) & (p < 1), F.when(q < 0, p).otherwise(1 - p))))
    tail = F.when(s <= 5, polynomial(s - 1.6, _AS_C) / polynomial(s - 1.6, _AS_D)).otherwise(polynomial(s - 5, _AS_E) / polynomial(s - 5, _AS_F))
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -tail).otherwise(tail))
