"""Scores of earlier versions, for results that were made with them. Prefer those of scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars
from .chem import col


def p_score(energy, area, total_asa) -> Column:
    """Deviations from a fixed expectation per area; null where there is no area. Turn into a P-value with p_value()."""
    spread = F.when(col(area) * 0.020 > 0, col(area) * 0.020).otherwise(0.01)
    return F.when((col(area) > 0) & (col(total_asa) > 0), (col(energy) + 0.025 * col(area)) / spread)


def p_value(score) -> Column:
    p = F.least(F.greatest(scalars.normal_cdf(score), F.lit(0.001)), F.lit(0.999))
    return F.coalesce(p, F.lit(0.5))


def kind(p, css, area) -> Column:
    """biological or crystal, by three thresholds together."""
    return F.when((col(p) < 0.5) & (col(css) >= 0.5) & (col(area) >= 800), "biological").otherwise("crystal")


def area_entropy(area, residues_1, residues_2) -> Column:
    return 0.02 * col(area) + 0.5 * (col(residues_1) + col(residues_2))


def stabilization(solvation, hydrogen_bonds, salt_bridges, disulfides) -> Column:
    return col(solvation) + scalars.bond_energy(hydrogen_bonds, salt_bridges, disulfides)


def dissociation_sum(solvation, entropy) -> Column:
    """An aggregate: what all interfaces' energies and entropies come to."""
    return F.sum(-col(solvation) + col(entropy))


def interface_area(alone_1, alone_2, combined) -> Column:
    return F.greatest((col(alone_1) + col(alone_2) - col(combined)) / 2, F.lit(0.0))


def full_sphere_burial(radius, asa) -> Column:
    """What is left of an atom's bare sphere; overstates burial."""
    return F.lit(4 * math.pi) * col(radius) * col(radius) - col(asa)
