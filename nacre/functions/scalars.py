"""Scores and energies as Column expressions; the normal distribution's integral from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .chem import col


_SERIES = [1.0]
for _k in range(1, 44):
    _SERIES.append(-_SERIES[-1] / _k)
#: Taylor coefficients of the error function's integrand, integrated, highest first.
_SERIES = [c / (2 * k + 1) for k, c in enumerate(_SERIES)][::-1]


def erf(x) -> Column:
    """The error function, to about 1e-15: its Taylor series up to 2.5, a continued fraction beyond.

    There is no erf among the built-in functions; folds over fixed arrays keep the expression small."""
    v = col(x)
    z = F.abs(v)
    series = F.aggregate(F.array(*[F.lit(c) for c in _SERIES]), F.lit(0.0), lambda a, c: a * v * v + c)
    small = F.lit(2 / 3.141592653589793**0.5) * z * series
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda a, k: (k / 2) / (z + a))
    big = 1 - F.exp(-v * v) / ((z + frac) * F.lit(3.141592653589793**0.5))
    return F.signum(v) * F.when(z < 2.5, small).otherwise(big)


def normal_cdf(z) -> Column:
    return F.lit(0.5) * (1 + erf(col(z) / F.lit(2**0.5)))


def bond_energy(hydrogen_bonds, salt_bridges, disulfides) -> Column:
    return F.lit(T.E_HYDROGEN_BOND) * col(hydrogen_bonds) + F.lit(T.E_SALT_BRIDGE) * col(salt_bridges) + F.lit(T.E_DISULFIDE) * col(disulfides)


def css(energy, area) -> Column:
    """Complex significance: a logistic function of solvation energy and log area."""
    x = F.lit(T.CSS_CONSTANT) + F.lit(T.CSS_ENERGY) * col(energy) + F.lit(T.CSS_LOG_AREA) * F.log1p(F.greatest(col(area), F.lit(0.0)))
    return 1 / (1 + F.exp(-x))


def p_score(energy, buried, buried_squares, mean_sigma, var_sigma) -> Column:
    """How many deflated deviations an interface's gain lies from a random patch's; null where there is nothing to judge."""
    var = col(buried_squares) * col(var_sigma)
    return F.when(var > 1e-12, (col(energy) - col(buried) * col(mean_sigma)) / F.sqrt(var) * F.lit(T.P_VALUE_SCALE))


def p_value(score) -> Column:
    """Chance that a patch of the surface burying the same areas gains as much, from p_score as a column; 0.5 for null."""
    return F.coalesce(F.least(F.greatest(normal_cdf(score), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def entropy(masses) -> Column:
    """T dS of parts coming apart, from their masses (array); 0 for fewer than two."""
    m = col(masses)
    logs = F.aggregate(m, F.lit(0.0), lambda a, x: a + F.log(x))
    total = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    rt = T.GAS_CONSTANT * T.TEMPERATURE
    return F.when(F.size(m) < 2, F.lit(0.0)).otherwise(F.lit(rt) * (1.5 * logs - 1.5 * F.log(total) + (F.size(m) - 1) * F.lit(T.ENTROPY_LOG_TERM)))


def confidence_weight(pae=None, plddt=None, pae_threshold: float = 10, plddt_threshold: float = 50) -> Column:
    """1, or less for an interface of doubtful model: by aligned error where there is one, else by pLDDT."""
    one = F.lit(1.0)
    by_plddt = one if plddt is None else F.when(col(plddt) < plddt_threshold, F.greatest(F.lit(0.1), col(plddt) / F.lit(float(plddt_threshold)))).otherwise(one)
    if pae is None:
        return by_plddt
    by_pae = F.greatest(F.lit(0.1), 1 - (col(pae) - pae_threshold) / F.lit(float(pae_threshold)))
    return F.when(col(pae) > pae_threshold, by_pae).otherwise(by_plddt)


def author_chain(label) -> Column:
    """The chain of a molecule's label: [ZN]A:301 is of A."""
    inside = F.regexp_extract(col(label), r"^\[[^\]]*\]([^:]*)", 1)
    return F.when(col(label).startswith("["), inside).otherwise(col(label))


def composition_counts(formula) -> Column:
    """E[4]I[4][CA][4] as a map of counts by name."""
    f = col(formula)
    names, numbers = F.regexp_extract_all(f, F.lit(r"(\[[A-Za-z0-9]+\]|[A-Za-z0-9]+)(?:\[(\d+)\])?"), F.lit(1)), F.regexp_extract_all(f, F.lit(r"(\[[A-Za-z0-9]+\]|[A-Za-z0-9]+)(?:\[(\d+)\])?"), F.lit(2))
    return F.map_from_arrays(F.transform(names, lambda x: F.translate(x, "[]", "")), F.transform(numbers, lambda x: F.when(x == "", 1).otherwise(x.cast("int"))))


def mate_label(symop_no, i, j, k) -> Column:
    """<operator>_<cell>, the cell's shifts counted from 5."""
    return F.concat(col(symop_no).cast("string"), F.lit("_"), *[(col(c) + 5).cast("string") for c in (i, j, k)])


def residue_label(chain, res, seq, icode=None) -> Column:
    parts = [col(chain), F.lit("/"), col(res), col(seq).cast("string")]
    return F.concat(*parts, *([F.coalesce(col(icode), F.lit(""))] if icode is not None else []))
