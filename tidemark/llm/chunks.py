"""Cutting texts where every tokenizer of this folder cuts too, and bounded caches of a worker.

A single space between two other characters that are not white space always ends one pre-token and, with
byte-level tokenizers, begins the next. A chunk between two such cuts is therefore encoded alike wherever it
stands, and its result can be kept.
"""

from __future__ import annotations

import ctypes
import re
import weakref
from collections.abc import Iterator

import pyarrow as pa

_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Texts are worked on in groups of about so many characters.
GROUP_CHARS = 2_000_000


def cut(text: str) -> list[str]:
    """Chunks without the space before them, which all but the first have. Python's white space includes all that
    the tokenizers' patterns count as such, so a cut is never wrong, only sometimes missing."""
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


def groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column, nulls as empty texts, in groups of bounded size."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


class Cache:
    """What a worker keeps between groups, in two generations. `young` holds all that the present group needs; when it has
    grown past `limit` it becomes the old one, from which what is needed again comes back."""

    every: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}
        Cache.every.add(self)

    def missing(self, wanted: set) -> list:
        """Call first in each group: makes room, and says what of `wanted` has to be worked out and put into `young`."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = wanted.difference(young)
        back = new.intersection(old)
        young.update((k, old[k]) for k in back)
        return list(new.difference(back))

    @classmethod
    def rest(cls, *used: Cache) -> None:
        """At the end of a partition, or before its first row: what other operators left in this worker goes, and so do the old
        generations. Memory that is free goes back to the system, as the worker may lie idle beside other stages."""
        for cache in list(cls.every):
            cache.old = {}
            if not any(cache is u for u in used):
                cache.young = {}
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
