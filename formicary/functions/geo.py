"""Distances on the Earth in kilometres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere; stays in generated code."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def vincenty_array(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Ellipsoidal distances on WGS-84 by Vincenty's inverse formula; nan for nan and where it doesn't converge.

    All rows iterate at once; those that have converged drop out.
    """
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    out = np.full(len(lat1), np.nan)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    s1, c1, s2, c2, lam = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), span
    rows = np.flatnonzero(~np.isnan(u1 + u2 + span))
    s1, c1, s2, c2, span, lam = (x[rows] for x in (s1, c1, s2, c2, span, lam))
    for _ in range(200):
        if not len(rows):
            break
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        same = sin_s == 0
        cos_s = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = c1 * c2 * sl / np.where(same, 1.0, sin_s)
        cos2_a = 1 - sin_a**2
        flat = cos2_a == 0  # along the equator
        cos_m = np.where(flat, 0.0, cos_s - 2 * s1 * s2 / np.where(flat, 1.0, cos2_a))
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = span + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
        k = cos2_a * (a * a - b * b) / (b * b)
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        done = same | (np.abs(new - lam) < 1e-12)
        out[rows[done]] = np.where(same, 0.0, b * big_a * (sigma - delta))[done]
        rows, lam = rows[~done], new[~done]
        s1, c1, s2, c2, span = (x[~done] for x in (s1, c1, s2, c2, span))
    return out


def vincenty(lat1: float, lon1: float, lat2: float, lon2: float) -> float | None:
    """The distance of one pair; None if it doesn't converge."""
    found = vincenty_array(*(np.array([v], np.float64) for v in (lat1, lon1, lat2, lon2)))[0]
    return None if np.isnan(found) else float(found)


@F.pandas_udf(DoubleType())
def vincenty_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Vincenty's distance for columns; null where an input is null or it doesn't converge."""
    found = vincenty_array(*(x.to_numpy(np.float64, na_value=np.nan) for x in (lat1, lon1, lat2, lon2)))
    return pd.Series(found, dtype="Float64").mask(np.isnan(found))
