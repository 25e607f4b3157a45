"""Pandas frames that are handed to Spark."""

from __future__ import annotations

import pandas as pd


def plain(rows: list[tuple], columns: list[str], strings: tuple[str, ...]) -> pd.DataFrame:
    """A frame of ``rows`` with string columns as plain objects, which turn into one Arrow array each."""
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({c: object for c in strings})
