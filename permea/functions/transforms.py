"""Target transforms (P21-P23) as forward/inverse Column pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip, col

REJECTIONS = ("Mg_rej", "Li_rej")


def fwd_transform(target: str, y) -> Column:
    """Rejections -> log1p(max(100-y, 0)); fluxes and PWP -> log1p(max(y, 0))."""
    y = col(y)
    if target in REJECTIONS:
        return F.log1p(clip(100.0 - y, 0.0))
    return F.log1p(clip(y, 0.0))


def inv_transform(target: str, z) -> Column:
    z = col(z)
    if target in REJECTIONS:
        return 100.0 - F.expm1(z)
    return F.expm1(z)


def stage1_fwd(char: str, y, transform: str | None) -> Column:
    """Log only for the characterisation marked ``log`` (MWCO)."""
    y = col(y)
    return F.log1p(clip(y, 0.0)) if transform == "log" else y


def stage1_inv(char: str, z, transform: str | None) -> Column:
    z = col(z)
    return F.expm1(z) if transform == "log" else z


def logit_fwd(y) -> Column:
    """log(p/(100-p)) with both parts clipped to [0.5, 99.5]."""
    y = col(y)
    return F.log(clip(y, 0.5, 99.5) / clip(100.0 - y, 0.5, 99.5))


def logit_inv(z) -> Column:
    return 100.0 / (1.0 + F.exp(-clip(z, -12.0, 12.0)))


# Named (forward, inverse) pairs of the audit: raw, complement-log, logit.
def transform_pair(name: str, target: str = "Mg_rej"):
    if name == "raw":
        return (lambda y: col(y)), (lambda z: col(z))
    if name == "complement_log":
        return (lambda y: fwd_transform(target, y)), (lambda z: inv_transform(target, z))
    if name == "logit":
        return logit_fwd, logit_inv
    raise ValueError(name)
