"""Spans that are kept, looked up by where they stand."""

from __future__ import annotations

from bisect import bisect_left, insort


def alike(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two spans share half of what they cover together, or one holds the other."""
    shared = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    whole = max(a[1], b[1]) - min(a[0], b[0])
    inside = (a[0] >= b[0] and a[1] <= b[1]) or (b[0] >= a[0] and b[1] <= a[1])
    return whole > 0 and (2 * shared >= whole or inside)


class Kept:
    """Spans with numbers; the smallest number of those that are alike to a span.

    Spans of about one length (within a factor of two) are one sorted list, so
    that what can be alike stands side by side in each.  Spans that are kept are
    not alike among themselves, so that few of one list overlap any place."""

    def __init__(self) -> None:
        self.lists: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, number: int, span: tuple[int, int]) -> None:
        insort(self.lists.setdefault((span[1] - span[0]).bit_length(), []), (*span, number))

    def remove(self, number: int, span: tuple[int, int]) -> None:
        of_length = self.lists[(span[1] - span[0]).bit_length()]
        del of_length[bisect_left(of_length, (*span, number))]

    def first(self, span: tuple[int, int]) -> int | None:
        own, found = (span[1] - span[0]).bit_length(), None
        for length, spans in self.lists.items():
            # Spans of this list are shorter than 1 << length; those that are much shorter can only lie within.
            begin = span[0] if length + 1 < own else span[0] - (1 << length)
            at = bisect_left(spans, (begin,))
            while at < len(spans) and spans[at][0] <= span[1]:
                start, end, number = spans[at]
                if (found is None or number < found) and alike(span, (start, end)):
                    found = number
                at += 1
        return found
