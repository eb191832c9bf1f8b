"""Coverage: raw listings -> cleaned names -> merged names -> what the atlas has and lacks."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from graftline.operators import gaps
from graftline.plans.lineage import cut


class Coverage(NamedTuple):
    listed: DataFrame
    names: DataFrame
    aliases: DataFrame
    have: DataFrame
    covered: DataFrame


def coverage(listing: DataFrame, varieties: DataFrame) -> Coverage:
    """Listed names as consolidated and as merged, the aliases of the merged ones, the atlas keys and the covered keys.

    Names are merged before anything is counted.  What several steps read is cut off once."""
    clean = cut(gaps.clean_listing(listing))
    listed, aliases, have = cut(gaps.consolidate(clean)), cut(gaps.alias_keys(clean)), cut(gaps.atlas_keys(varieties))
    names = cut(gaps.merge_candidates(listed, aliases, have))
    own = cut(aliases.join(names.select("key"), "key", "left_semi"))
    return Coverage(listed, names, own, have, gaps.covered_keys(names, own, have))
