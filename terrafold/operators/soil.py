"""Soil moisture that a pixel carries from day to day, as a batch and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Share of the field capacity that a pixel begins with, and of the rain that the soil takes in (fixed values).
START, TAKEN = 0.6, 0.7
COLUMNS = ["tile_id", "r", "c", "day", "precip_mm", "eto", "awc", "fc", "wp"]
RESULT = "tile_id long, r int, c int, day date, soil_moisture double"
#: Days without rows after which a stream forgets a tile.
FORGET = 30
_STATE = "until long, r binary, c binary, moisture binary"


class Carried:
    """The moisture of a tile's pixels after the last day, by place."""

    def __init__(self, until: int = -(1 << 62), r=(), c=(), moisture=()):
        self.until, self.at = until, pd.Series(moisture, index=pd.MultiIndex.from_arrays([r, c]) if len(r) else None, dtype=float)

    def days(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Moisture at the end of each day, in order; days that aren't after the last one are left out, of a pixel's rows of one day the last counts.

        A pixel begins with START of its field capacity. One without rain, evaporation or soil (awc > 0) keeps what it has.
        """
        for day, now in rows.sort_values(["day", "r", "c", "precip_mm", "eto"]).groupby("day", sort=True):
            number = pd.Timestamp(day).toordinal()
            if number <= self.until:
                continue
            now = now.drop_duplicates(["r", "c"], keep="last")
            place = pd.MultiIndex.from_arrays([now["r"], now["c"]])
            before = self.at.reindex(place).to_numpy() if len(self.at) else np.full(len(now), np.nan)
            fc, wp, awc = (now[x].to_numpy(float) for x in ("fc", "wp", "awc"))
            before = np.where(np.isnan(before), START * fc, before)
            awc = np.where(awc > 0, awc, np.nan)
            after = np.maximum(wp, np.minimum(fc, before + TAKEN * now["precip_mm"].to_numpy(float) / awc - now["eto"].to_numpy(float) / awc))
            after = np.where(np.isnan(after), before, after)
            fresh = pd.Series(after, index=place)
            self.at = fresh if not len(self.at) else pd.concat([self.at[~self.at.index.isin(place)], fresh])
            self.until = number
            yield now[["tile_id", "r", "c", "day"]].assign(soil_moisture=after)

    def state(self) -> tuple:
        r, c = (np.array([x[k] for x in self.at.index], np.int32) for k in (0, 1))
        return self.until, r.tobytes(), c.tobytes(), self.at.to_numpy(float).tobytes()

    @classmethod
    def of(cls, state: tuple) -> Carried:
        until, r, c, m = state
        return cls(until, np.frombuffer(bytes(r), np.int32), np.frombuffer(bytes(c), np.int32), np.frombuffer(bytes(m), float))


def _narrow(pixels: DataFrame) -> DataFrame:
    kinds = {"tile_id": "long", "r": "int", "c": "int", "day": "date"}
    return pixels.select(*(F.col(c).cast(kinds.get(c, "double")).alias(c) for c in COLUMNS)).filter("tile_id is not null and r is not null and c is not null and day is not null")


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile's moisture from its first day to its last, as Carried.days: a day is a few operations on arrays by place."""
    r, c, day, rain, eto = (rows[x].to_numpy() for x in ("r", "c", "day", "precip_mm", "eto"))
    order = np.lexsort((eto, rain, c, r, day))
    r, c, day = r[order].astype(np.int64), c[order].astype(np.int64), day[order]
    last = np.ones(len(order), bool)
    last[:-1] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (day[1:] != day[:-1])
    order, r, c, day = order[last], r[last], c[last], day[last]
    places, place = np.unique((r - r.min()) * (c.max() - c.min() + 1) + c - c.min(), return_inverse=True)
    fc, wp, awc = (rows[x].to_numpy(float)[order] for x in ("fc", "wp", "awc"))
    awc = np.where(awc > 0, awc, np.nan)
    come, gone = TAKEN * rain[order].astype(float) / awc, eto[order].astype(float) / awc
    at, out = np.full(len(places), np.nan), np.empty(len(order))
    starts = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(day)]):
        before = at[place[a:b]]
        before = np.where(np.isnan(before), START * fc[a:b], before)
        after = np.maximum(wp[a:b], np.minimum(fc[a:b], before + come[a:b] - gone[a:b]))
        out[a:b] = at[place[a:b]] = np.where(np.isnan(after), before, after)
    return pd.DataFrame({"tile_id": rows["tile_id"].iloc[0], "r": r, "c": c, "day": day, "soil_moisture": out})


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts) if parts else pd.DataFrame({"tile_id": [], "r": [], "c": [], "day": [], "soil_moisture": []})


def carried_moisture(pixels: DataFrame) -> DataFrame:
    """tile_id, r, c, day, soil_moisture of pixels with a day's rain and evaporation and their soil (COLUMNS).

    A task holds the days of one tile. Rows without a place or a day are left out.
    """
    # Dates travel as numbers: a pandas date is an object for each row.
    numbered = _narrow(pixels).withColumn("day", F.unix_date("day"))
    found = numbered.groupBy("tile_id").applyInPandas(_folded, RESULT.replace("day date", "day int"))
    return found.withColumn("day", F.date_from_unix_date("day"))


def moisture_stream(pixels: DataFrame, late: str = "0 days") -> DataFrame:
    """The same of a stream: each tile's moisture is state, so a day costs no look at the days before.

    Days come in order; one that comes after a later day of its tile is left out. FORGET days after the watermark has
    passed a tile's last day its state goes, and the tile begins anew.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p.assign(day=p["at"].dt.date) for p in parts])
        tile = Carried.of(state.get) if state.exists else Carried()
        yield _joined(list(tile.days(rows)))
        state.update(tile.state())
        last = int((pd.Timestamp.fromordinal(tile.until) + pd.Timedelta(days=FORGET)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    timed = _narrow(pixels).withColumn("at", F.col("day").cast("timestamp")).drop("day").withWatermark("at", late)
    return timed.groupBy("tile_id").applyInPandasWithState(fold, RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
