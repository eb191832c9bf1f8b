"""Flavour evidence: sources -> one written table of evidence -> support, counts, decisions and the tags shown."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from graftline.operators import evidence as ev
from graftline.plans.lineage import cut


class Merged(NamedTuple):
    evidence: DataFrame
    voices: DataFrame
    support: DataFrame
    counts: DataFrame
    decisions: DataFrame
    added: DataFrame
    final: DataFrame


def merge(evidence: DataFrame, varieties: DataFrame) -> Merged:
    """Everything that follows from the evidence of known varieties.

    The sources are read once: the evidence, and per variety and tag what it says, are written to the shared folder."""
    e = cut(evidence)
    voices = cut(ev.tag_voices(e))
    support, counts = cut(ev.tag_support(voices)), cut(ev.source_counts(e))
    recorded = ev.recorded_tags(varieties)
    decisions, added = ev.decide_tags(recorded, support, counts), ev.added_tags(recorded, support)
    return Merged(e, voices, support, counts, decisions, added, ev.final_tags(decisions, added))
