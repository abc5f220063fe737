"""Results of read-only statements, kept on the driver as Arrow tables under canonical SQL.

Bounded by entries, rows of an entry and age. A generation number closes the gap between running a statement and keeping its
result: what was computed before a clear is not kept after it.
"""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa

_PARTS = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\s+|[^\s'"`]+""")
# Words whose case doesn't matter to a statement's meaning.
KEYWORDS = frozenset(
    "select from where group by order having limit offset as and or not in is null between like join inner left right full outer "
    "cross on using union all intersect except distinct with case when then else end asc desc nulls first last over partition rows range".split()
)


def canonical(sql: str) -> str:
    """Statements that differ by white space, case of keywords or a final semicolon have one key; quoted text and names keep
    theirs, and so does the case of names (a miss at worst, never another statement's result)."""
    out: list[str] = []
    for part in _PARTS.findall(sql.strip().rstrip(";").strip()):
        if part[0] in "'\"`":
            out.append(part)
        elif part.isspace():
            out.append(" ")
        else:
            folded = re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda m: m[0].lower() if m[0].lower() in KEYWORDS else m[0], part)
            out.append(folded)
    text = "".join(out)
    pieces = re.split(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)""", text)
    return "".join(p if i % 2 else re.sub(r"\s*([,()])\s*", r"\1", p) for i, p in enumerate(pieces)).strip()


def cacheable(sql: str) -> bool:
    """Only statements that begin with SELECT or WITH."""
    first = re.match(r"\s*([A-Za-z]+)", sql)
    return bool(first) and first[1].lower() in ("select", "with")


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0
    evictions_lru: int = 0
    evictions_ttl: int = 0
    entries: int = 0


class ResultCache:
    def __init__(self, max_entries: int = 1024, ttl_seconds: float = 300, max_rows: int = 100_000, clock: Callable[[], float] = time.monotonic):
        if max_entries <= 0 or ttl_seconds <= 0 or max_rows <= 0:
            raise ValueError("limits must be positive")
        self.max_entries, self.ttl, self.max_rows, self._clock = max_entries, ttl_seconds, max_rows, clock
        self._held: OrderedDict[str, tuple[float, pa.Table]] = OrderedDict()
        self._lock, self._stats, self.generation = threading.Lock(), Stats(), 0

    def get(self, sql: str) -> pa.Table | None:
        key = canonical(sql)
        with self._lock:
            found = self._held.get(key)
            if found and self._clock() - found[0] <= self.ttl:
                self._held.move_to_end(key)
                self._stats.hits += 1
                return found[1]
            if found:
                del self._held[key]
                self._stats.evictions_ttl += 1
            self._stats.misses += 1
            return None

    def set(self, sql: str, table: pa.Table, generation: int | None = None) -> bool:
        """False if the result is too large or from before a clear."""
        key = canonical(sql)
        with self._lock:
            if table.num_rows > self.max_rows or (generation is not None and generation != self.generation):
                return False
            if key not in self._held and len(self._held) >= self.max_entries:
                self._held.popitem(last=False)
                self._stats.evictions_lru += 1
            self._held[key] = (self._clock(), table)
            self._held.move_to_end(key)
            return True

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.generation += 1

    def __len__(self) -> int:
        return len(self._held)

    def stats(self) -> Stats:
        with self._lock:
            return Stats(**(self._stats.__dict__ | {"entries": len(self._held)}))
