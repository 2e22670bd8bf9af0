"""Joins, rankings and lists that hold up when one key has most of the rows."""

from dealflow.plans.aggregate import with_lists
from dealflow.plans.checkpoint import settled
from dealflow.plans.lookup import fits_broadcast, join_lookup
from dealflow.plans.product import count_pairs, pair_partitions, paired_in_order
from dealflow.plans.rank import down, numbered, ranked
from dealflow.plans.textlist import listed

__all__ = [
    "count_pairs",
    "down",
    "fits_broadcast",
    "join_lookup",
    "listed",
    "numbered",
    "pair_partitions",
    "paired_in_order",
    "ranked",
    "settled",
    "with_lists",
]
