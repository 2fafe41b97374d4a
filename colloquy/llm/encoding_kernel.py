"""Segmented running sums over sorted partitions, and what each takes over from those before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext

#: Groups of rows that do not count for each other: a row counts those of the other folds.
FOLDS = 5

#: Of a partition: its first and last segment and time, the last segment's sums by fold, and those before its last time.
_EDGE = (
    "part int, first_level int, first_key bigint, first_name string, first_at bigint, first_id bigint, last_level int, last_key bigint, last_name string, last_at bigint, "
    "one_segment boolean, one_time boolean, sums array<bigint>, earlier array<bigint>"
)
SCANNED = f"level int, id bigint, fold int, zone int, part int, n bigint, s bigint, edge struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>"

#: Places of a row in its partition: a later segment, the first segment, and the first time of the first segment.
_LATER, _FIRST_SEGMENT, _FIRST_TIME = 0, 1, 2


def _carry(by_row: np.ndarray, starts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each row, by_row at the last start up to it; before any start, held."""
    at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
    return np.where((at >= 0)[:, None], by_row[np.maximum(at, 0)], held)


class _Scan:
    """Running sums of one sorted partition, batch by batch."""

    def __init__(self):
        self.part = TaskContext.get().partitionId()
        self.total = np.zeros(2 * FOLDS, np.int64)  # of all rows so far: counts by fold, then sums by fold
        self.segment_from = self.time_from = self.total
        self.first = self.last = None
        self.segments = self.times = 0

    def batch(self, rows: pd.DataFrame) -> pd.DataFrame:
        m = len(rows)
        level, key, name, at = rows["level"].to_numpy(), rows["key"].to_numpy(), rows["name"].to_numpy(), rows["at"].to_numpy()
        fold, own = rows["fold"].to_numpy(), np.arange(m)
        by_fold = np.zeros((m, 2 * FOLDS), np.int64)
        by_fold[own, fold], by_fold[own, fold + FOLDS] = rows["n"].to_numpy(), rows["s"].to_numpy()
        upto = np.cumsum(by_fold, axis=0) + self.total
        before = upto - by_fold
        new_segment, new_time = np.ones(m, bool), np.ones(m, bool)
        new_segment[1:] = (level[1:] != level[:-1]) | (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        here = (level[0], key[0], name[0], at[0])
        new_segment[0] = self.last is None or self.last[:3] != here[:3]
        new_time[1:] = new_segment[1:] | (at[1:] != at[:-1])
        new_time[0] = new_segment[0] or self.last[3] != at[0]
        if self.first is None:
            self.first = (*here, rows["id"].iat[0])
        segment_from, time_from = _carry(before, new_segment, self.segment_from), _carry(before, new_time, self.time_from)
        seen = time_from - segment_from
        n = seen[:, :FOLDS].sum(axis=1) - seen[own, fold]
        s = seen[:, FOLDS:].sum(axis=1) - seen[own, fold + FOLDS]
        segment_no, time_no = self.segments + np.cumsum(new_segment), self.times + np.cumsum(new_time)
        zone = np.where(time_no == 1, _FIRST_TIME, np.where(segment_no == 1, _FIRST_SEGMENT, _LATER))
        self.total, self.segment_from, self.time_from = upto[-1], segment_from[-1], time_from[-1]
        self.segments, self.times = int(segment_no[-1]), int(time_no[-1])
        self.last = (level[-1], key[-1], name[-1], at[-1])
        return pd.DataFrame({"level": level, "id": rows["id"].to_numpy(), "fold": fold, "zone": zone.astype(np.int32), "part": np.full(m, self.part, np.int32), "n": n, "s": s, "edge": None})

    def edge(self) -> pd.DataFrame:
        plain = lambda row: [x.item() if isinstance(x, np.generic) else x for x in row]
        names = [f.split()[0] for f in _EDGE.split(", ")]
        sums, earlier = (self.total - self.segment_from).tolist(), (self.time_from - self.segment_from).tolist()
        values = [self.part, *plain(self.first), *plain(self.last), self.segments == 1, self.times == 1, sums, earlier]
        return pd.DataFrame({**{c: [0] for c in ("level", "id", "fold", "zone", "part", "n", "s")}, "edge": [dict(zip(names, values, strict=True))]})


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = _Scan()
    for rows in batches:
        if len(rows):
            yield own.batch(rows)
    if own.first is not None:
        yield own.edge()


def carried(edges: list) -> list[tuple[int, int, int, int, int]]:
    """(part, zone, fold, n, s): what rows of a partition's first segment count from the partitions before it, other folds only."""
    out, segment, time = [], None, None
    upto, earlier = np.zeros(2 * FOLDS, np.int64), np.zeros(2 * FOLDS, np.int64)
    for e in sorted(edges, key=lambda e: (e.first_level, e.first_key, e.first_name, e.first_at, e.first_id)):
        first, last = (e.first_level, e.first_key, e.first_name), (e.last_level, e.last_key, e.last_name)
        goes_on, same_time = first == segment, first == segment and e.first_at == time
        if goes_on:
            for zone, sums in ((_FIRST_SEGMENT, upto), (_FIRST_TIME, earlier if same_time else upto)):
                n, s = int(sums[:FOLDS].sum()), int(sums[FOLDS:].sum())
                out += [(e.part, zone, f, n - int(sums[f]), s - int(sums[f + FOLDS])) for f in range(FOLDS)]
        own, before = np.array(e.sums, np.int64), np.array(e.earlier, np.int64)
        if goes_on and e.one_segment:
            earlier = earlier if same_time and e.one_time else upto + before
            upto = upto + own
        else:
            upto, earlier = own, before
        segment, time = last, e.last_at
    return out
