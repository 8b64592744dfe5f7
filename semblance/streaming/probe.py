"""A stream of documents probing a static banded index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LshConfig
from ..operators.lsh import slices


def probe(index: DataFrame, signed: DataFrame, config: LshConfig, index_id: str, id: str) -> DataFrame:
    """(index_id, id) of signed documents, a stream or a table, that share a
    band with an indexed one; a pair comes once for every band it shares.
    Stateless, so a stream needs no watermark."""
    bands = signed.where(F.size("shingles") > 0).select(id, F.posexplode(slices(F.col("signature"), config)).alias("band", "key"))
    return bands.join(index.select(index_id, "band", "key"), ["band", "key"]).select(index_id, id)
