"""Bundles: one archive a document, the same bytes for the same input."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType


def archive(markdown: str, ir: str, assets: dict[str, bytes]) -> bytes:
    """document.md, document.json and the assets by name, stored with the format's first date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in [("document.md", markdown.encode()), ("document.json", ir.encode()), *((f"assets/{k}", assets[k]) for k in sorted(assets))]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def bundles(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bundle) of documents (key, markdown, ir, assets: map of name to bytes); nulls are empty."""

    @F.pandas_udf(BinaryType())
    def packed(md: pd.Series, ir: pd.Series, names: pd.Series, data: pd.Series) -> pd.Series:
        rows = zip(md, ir, names, data, strict=True)
        return pd.Series([archive(m or "", j or "", dict(zip([] if n is None else n, [] if d is None else d, strict=True))) for m, j, n, d in rows], dtype=object)

    return docs.select(key, packed("markdown", "ir", F.map_keys("assets"), F.map_values("assets")).alias("bundle"))
