"""Repeatable bounded samples per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.operators.ranking import first_per_group


def sample_per_group(
    rows: DataFrame, group: Sequence[str], k: int | None, seed: int = S.SAMPLE_SEED, key: str = "id"
) -> DataFrame:
    """At most ``k`` rows per group: those with the smallest hash of key and seed.

    The draw depends on the data only, not on partitioning, and groups of up to
    ``k`` rows are kept whole. ``k=None`` keeps everything. A frequent word is drawn
    in slices first, so no task gets the candidates of all tasks.
    """
    if k is None:
        return rows
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return first_per_group(rows, group, [draw, key], k, "_draw", [key], sliced=True).drop("_draw")
