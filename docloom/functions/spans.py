"""Consecutive items in groups of a bounded total, by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def spans(sizes: Sequence[int], most: int, overlap: int, *, first_may_be_empty: bool = False) -> Iterator[tuple[int, int]]:
    """(from, to) of groups whose total does not exceed ``most``, each with the last ``overlap`` items of the one before.

    A group has at least one item of its own, however large; the first may be left empty before an item above ``most``.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    begin, least = 0, 0 if first_may_be_empty else 1
    while True:
        # the first prefix that is too much for this group; one item before it ends the group
        end = max(int(np.searchsorted(total, total[begin] + most, side="right")) - 1, least)
        if end >= len(sizes):
            yield begin, len(sizes)
            return
        yield begin, end
        begin, least = max(end - overlap, 0), end + 1
