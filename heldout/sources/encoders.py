"""Named feature makers: functions from a frames table to (scene_index, frame_index, x).

This is the extension point for embeddings.  Trained vision models run elsewhere;
their output enters as a table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.labels import block_means, random_features

_MAKERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(maker: Callable[..., DataFrame]):
        _MAKERS[name] = maker
        return maker
    return add


def make(name: str, rows: DataFrame, **options) -> DataFrame:
    if name not in _MAKERS:
        raise KeyError(f"unknown encoder {name!r}; known: {sorted(_MAKERS)}")
    return _MAKERS[name](rows, **options)


def known() -> list[str]:
    return sorted(_MAKERS)


@register("raw_pixel")
def raw_pixel(pixels: DataFrame, height: int = 224, width: int = 224, side: int = 32) -> DataFrame:
    return block_means(pixels, ["scene_index", "frame_index"], height, width, side)


@register("random_b")
def random_b(features: DataFrame, dim: int = 64, seed: int = 0) -> DataFrame:
    return random_features(features, "x", dim, seed)


@register("precomputed")
def precomputed(features: DataFrame) -> DataFrame:
    return features.select("scene_index", "frame_index", "x")
