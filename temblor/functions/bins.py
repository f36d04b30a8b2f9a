"""Binning expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_column(col, edges: list[float], labels: list[str], right: bool = True,
               include_lowest: bool = False, otherwise: str | None = None) -> Column:
    """Label of the interval that holds ``col``.

    ``right`` makes intervals ``(a, b]``, else ``[a, b)``. ``include_lowest``
    closes the first interval on the left. Values outside all intervals and
    nulls get ``otherwise``.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    col = F.col(col) if isinstance(col, str) else col
    chain = None
    for position, label in enumerate(labels):
        low, high = edges[position], edges[position + 1]
        tests = [col.isNotNull()]
        if not math.isinf(low):
            closed = not right or (include_lowest and position == 0)
            tests.append(col >= F.lit(low) if closed else col > F.lit(low))
        if not math.isinf(high):
            tests.append(col <= F.lit(high) if right else col < F.lit(high))
        test = tests[0]
        for more in tests[1:]:
            test = test & more
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain if otherwise is None else chain.otherwise(otherwise)


# Published class limits.
INF = math.inf
DEPTH_BAND = ([-INF, 70.0, 300.0, INF], ["shallow", "intermediate", "deep"])
MAG_BAND = ([-INF, 2.0, 4.0, 5.0, 6.0, 7.0, INF],
            ["micro_minor", "light", "moderate", "strong", "major", "great"])
DEPTH_CLASS = ([-INF, 70.0, 300.0, INF], ["Shallow", "Intermediate", "Deep"])
MAG_CLASS = ([-INF, 5.5, 6.0, 7.0, INF], ["Moderate", "Strong", "Major", "Great"])
MAG_TOKEN = ([0.0, 3.0, 4.5, 6.0, 10.5], ["M0_3", "M3_4_5", "M4_5_6", "M6_plus"])
DEPTH_TOKEN = ([0.0, 70.0, 300.0, 800.0], ["shallow", "intermediate", "deep"])
MAG_RANGE = ([-INF, 3.0, 5.0, 7.0, INF], ["0-3", "3-5", "5-7", "7+"])
DEPTH_RANGE = ([-INF, 50.0, 100.0, 300.0, INF], ["0-50km", "50-100km", "100-300km", "300km+"])
MAG_SCALE = ([0.0, 2.0, 3.0, 4.0, 5.0, 10.0],
             ["Micro (<2)", "Minor (2-3)", "Light (3-4)", "Moderate (4-5)", "Strong (≥5)"])
DEPTH_SCALE = ([0.0, 10.0, 35.0, 70.0, 300.0, 1000.0],
               ["Shallow (<10km)", "Intermediate (10-35km)", "Medium (35-70km)",
                "Deep (70-300km)", "Very Deep (>300km)"])
LAT_ZONE = ([-90.0, -60.0, -30.0, 0.0, 30.0, 60.0, 90.0],
            ["lat_-90_-60", "lat_-60_-30", "lat_-30_0", "lat_0_30", "lat_30_60", "lat_60_90"])
LON_ZONE = ([-180.0, -120.0, -60.0, 0.0, 60.0, 120.0, 180.0],
            ["lon_-180_-120", "lon_-120_-60", "lon_-60_0", "lon_0_60", "lon_60_120",
             "lon_120_180"])
MAG_ITEM = ([0.0, 3.0, 4.5, 6.0, 10.5], ["mag_low", "mag_moderate", "mag_strong", "mag_major"])
DEPTH_ITEM = ([0.0, 70.0, 300.0, 800.0],
              ["depth_shallow", "depth_intermediate", "depth_deep"])


def depth_band(col="depth") -> Column:
    return bin_column(col, *DEPTH_BAND)


def mag_band(col="mag") -> Column:
    return bin_column(col, *MAG_BAND)


def depth_class(col="depth") -> Column:
    return bin_column(col, *DEPTH_CLASS, right=False, otherwise="Unknown")


def mag_class(col="mag") -> Column:
    return bin_column(col, *MAG_CLASS, right=False, otherwise="Unknown")


def event_token(mag="mag", depth="depth") -> Column:
    """Magnitude bin and depth bin of an event as one token."""
    return F.concat(
        bin_column(mag, *MAG_TOKEN, right=False, otherwise="M_unknown"), F.lit("_"),
        bin_column(depth, *DEPTH_TOKEN, right=False, otherwise="depth_unknown"),
    )
