"""Panel import: accession names -> varieties -> genotype majority -> one record per variety."""
from __future__ import annotations

from pyspark.sql import DataFrame

from graftline.operators import lab, matching
from graftline.plans.lineage import cut


def kept_accessions(rows: DataFrame, index: DataFrame, curated: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Panel rows with the variety they are matched to and whether they count.

    The matches are read five times by the majority vote, so they are cut off first."""
    rows = lab.panel_rows(rows)
    matches = cut(matching.classify_accessions(rows, cut(index), curated, rejects).drop("name", "source").join(rows, "accession_id"))
    return cut(lab.panel_keep(matches))
