"""Boosted stumps over window features named by tokens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bouts import from_scores
from .series import over, transformed, window_stat


#: Beginnings of feature names (case, spaces and underscores aside), and the columns
#: they mean, in the order in which they are tried.
SYNONYMS = {
    "angle": "theta", "absangle": "theta", "theta": "theta",
    "speed": "vel", "velmag": "vel", "velocity": "vel", "dv": "dv",
    "dist2wall": "dist2wall", "dcenter": "dcenter",
    "dpartner": "dpartner", "disttoother": "dpartner", "distance2other": "dpartner",
    "bearing": "bearing_to_other", "bearingtoother": "bearing_to_other",
    "facing": "facing_angle", "facingangle": "facing_angle", "relangle": "facing_angle",
    "wings": "wing_angle", "wing": "wing_angle", "wingangle": "wing_angle",
    "area": "area", "angspeed": "angspeed", "dtheta": "angspeed",
}
#: Columns that stand in, in this order, where a feature names none.
DEFAULTS = ["vel", "theta", "dist2wall", "dcenter", "wing_angle", "dpartner", "area"]


@dataclass(frozen=True)
class Stump:
    """Votes direction * alpha if feature ``dim`` (from 1) is below ``thr``, else the opposite."""

    dim: int
    thr: float
    direction: int = 1
    alpha: float = 1.0


def token_map(tokens: Sequence[str]) -> dict[str, str]:
    """Alternating keys and values of a feature name."""
    return dict(zip(tokens[::2], tokens[1::2], strict=False))


def token_map_column(tokens: Column) -> Column:
    even = F.filter(tokens, lambda _, i: i % 2 == 0)
    odd = F.filter(tokens, lambda _, i: i % 2 == 1)
    return F.map_from_arrays(F.slice(even, F.lit(1), F.size(odd)), odd)


def feature_column(spec: dict, columns: Sequence[str]) -> str | None:
    """The column that a feature's perframe, feature or src means; None where there is no such column."""
    name = next((spec[k] for k in ("perframe", "feature", "src") if spec.get(k)), None)
    if isinstance(name, (list, tuple)):
        name = name[0]
    if name is None:
        return next((c for c in DEFAULTS if c in columns), None)
    plain = str(name).lower().replace(" ", "").replace("_", "")
    name = next((column for start, column in SYNONYMS.items() if plain.startswith(start)), str(name))
    return name if name in columns else None


def feature_tokens(own: Sequence | None, behavior: str, beside: dict[str, Sequence], folder: dict[str, Sequence]) -> Sequence | None:
    """A model's feature names: its own, or else those kept beside it, or else in its folder, for its behaviour (as letters and digits)."""
    plain = "".join(c for c in behavior.lower() if c.isalnum())
    return own or beside.get(plain) or folder.get(plain)


def window_features(df: DataFrame, keys: Sequence[str], specs: Sequence[dict], frame: str = "frame") -> DataFrame:
    """Columns f1, f2, .. of the specs (perframe, trans, stat, radius, offset); a feature without a column is 0.

    Specs with equal frames share a window, so Spark computes them in one pass.
    """
    w = over(keys, frame)
    new, columns = {}, list(df.columns)
    for k, spec in enumerate(specs, 1):
        name = feature_column(spec, columns)
        if name is None:
            new[f"f{k}"] = F.lit(0.0)
            continue
        df = transformed(df, keys, F.col(name), spec.get("trans") or spec.get("trans_types"), f"__t{k}")
        new[f"f{k}"] = window_stat(f"__t{k}", w, str(spec.get("stat") or "mean").lower(), int(spec.get("radius") or 5), int(spec.get("offset") or 0))
    return df.withColumns(new).drop(*(f"__t{k}" for k in range(1, len(specs) + 1)))


def vote(stump: Stump, feature: Column | None) -> Column:
    """A NULL feature is not below the threshold; a dimension that does not exist votes 0."""
    if feature is None:
        return F.lit(0.0)
    up = stump.direction * stump.alpha
    return F.when(feature < stump.thr, F.lit(float(up))).otherwise(F.lit(float(-up)))


def boosted_score(stumps: Sequence[Stump], features: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for s in stumps:
        total = total + vote(s, features[s.dim - 1] if 1 <= s.dim <= len(features) else None)
    return total


def array_score(stumps: Sequence[Stump], vector: Column) -> Column:
    """The same over an array column: one pass over the stumps, whose number may be large."""
    table = F.array(*(F.struct(F.lit(s.dim).alias("d"), F.lit(float(s.thr)).alias("t"), F.lit(float(s.direction * s.alpha)).alias("u")) for s in stumps))
    value = lambda s: F.get(vector, s["d"] - 1)
    inside = lambda s: (s["d"] >= 1) & (s["d"] <= F.size(vector))
    one = lambda s: F.when(~inside(s), F.lit(0.0)).when(value(s) < s["t"], s["u"]).otherwise(-s["u"])
    return F.aggregate(table, F.lit(0.0), lambda a, s: a + one(s))


def boosted_bouts(df: DataFrame, keys: Sequence[str], score: str, min_len: int = 3, frame: str = "frame") -> DataFrame:
    return from_scores(df, keys, F.col(score) > 0, min_len, 0, frame)
