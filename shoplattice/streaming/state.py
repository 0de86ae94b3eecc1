"""Keyed state with expiry by event time: carts, last activity, impression attribution.

Each processor keeps what its key still needs and sets one timer; when the watermark passes it, the key leaves the state.
Queries with these operators need the RocksDB state store, see ``run_to_table``.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from shoplattice.constants import CLICK_WINDOW_HOURS, CONVERSION_WINDOW_HOURS

HOUR = 3_600_000_000
#: After so many hours without an event a cart or a user's last activity is forgotten.
IDLE_HOURS = 90 * 24
#: Buckets of users and products, at least, and the rows of a trigger in one of them, about.
BUCKETS, BUCKET_ROWS = 192, 5_000


class _Expiring(StatefulProcessor):
    """One timer a key, moved forward with the key's newest event."""

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _expire_after(self, newest_us: int, timers: TimerValues) -> None:
        at = max(newest_us // 1000 + self.hours * HOUR // 1000, timers.getCurrentWatermarkInMs() + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Carts(_Expiring):
    """Newest add or remove of each of a user's products; emits the products of which it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getListState("items", "product_id long, at long, id long, event_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = {item[0]: (item[1], item[2], item[3]) for item in self.items.get()}
        changed = set()
        for pdf in rows:
            for product, at, number, kind in zip(pdf["product_id"], pdf["at"], pdf["id"], pdf["event_type"]):
                now = (int(at), int(number), kind)
                if product not in newest or newest[product] < now:
                    newest[int(product)] = now
                    changed.add(int(product))
        if newest:
            self.items.put([(product, *last) for product, last in newest.items()])
            self._expire_after(max(last[0] for last in newest.values()), timerValues)
        if changed:
            yield self._rows(key, [(product, *newest[product]) for product in sorted(changed)])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [(product, at, number, "expired") for product, at, number, _ in self.items.get()]
        self.items.clear()
        if gone:
            yield self._rows(key, gone)

    @staticmethod
    def _rows(key: tuple, items: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(items, columns=["product_id", "at", "id", "event_type"]).assign(user_id=key[0])[["user_id", "product_id", "at", "id", "event_type"]]


class LastActive(_Expiring):
    """Newest event time of a user; emits it when it moves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        at = max(int(pdf["at"].max()) for pdf in rows)
        if before is None or at > before:
            self.newest.update((at,))
            self._expire_after(at, timerValues)
            yield pd.DataFrame({"user_id": [key[0]], "at": [at]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())


class NewestImpression(_Expiring):
    """The impressions that an action can still be credited to, for a bucket of users and products: of each user and product
    the newest one before the watermark and those after it, if still in the window. Emits one row for each action with an
    impression in its window.

    A user has few rows of each product, and a call of Python for every one of those would take most of the time; a bucket
    holds many of them, each whole."""

    def __init__(self) -> None:
        super().__init__(CONVERSION_WINDOW_HOURS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.shown = handle.getListState("shown", "user_id long, product_id long, at long, id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        shown: dict[tuple[int, int], list[tuple[int, int]]] = {}
        acts: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
        for user, product, at, number in self.shown.get():
            shown.setdefault((user, product), []).append((at, number))
        for pdf in rows:
            columns = [pdf[name].tolist() for name in ("user_id", "product_id", "at", "id", "event_type")]
            for user, product, at, number, kind in zip(*columns):
                if kind == "product_view":
                    shown.setdefault((user, product), []).append((at, number))
                else:
                    acts.setdefault((user, product), []).append((at, number, kind))
        watermark, kept, credited = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for pair, views in shown.items():
            views.sort()
            seen = 0
            for at, number, kind in sorted(acts.get(pair, ())):
                while seen < len(views) and views[seen][0] <= at:
                    seen += 1
                window = (CLICK_WINDOW_HOURS if kind == "click" else CONVERSION_WINDOW_HOURS) * HOUR
                if seen and views[seen - 1][0] >= at - window:
                    credited.append((number, kind, views[seen - 1][1]))
            settled = sum(at <= watermark for at, _ in views)
            kept += [(*pair, at, number) for at, number in views[max(0, settled - 1):] if at >= watermark - CONVERSION_WINDOW_HOURS * HOUR]
        if kept:
            self.shown.put(kept)
            self._expire_after(max(row[2] for row in kept), timerValues)
        elif shown:
            self.shown.clear()
        if credited:
            yield pd.DataFrame(credited, columns=["event_id", "event_type", "impression_id"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.shown.clear()
        return iter(())


def _keyed(stream: DataFrame, lateness: str) -> DataFrame:
    return stream.withWatermark("occurred_at", lateness).withColumn("at", F.unix_micros("occurred_at"))


def cart_updates(stream: DataFrame, lateness: str, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """Changed cart rows (user_id, product_id, at, id, event_type); those of a forgotten cart come as 'expired'. Update mode."""
    rows = _keyed(stream.where("event_type IN ('add_to_cart', 'remove_from_cart')"), lateness)
    out = rows.groupBy("user_id").transformWithStateInPandas(
        Carts(idle_hours), "user_id long, product_id long, at long, id long, event_type string", "Update", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def last_active(stream: DataFrame, lateness: str, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """(user_id, last_active_at) whenever it moves. Update mode."""
    out = _keyed(stream, lateness).groupBy("user_id").transformWithStateInPandas(LastActive(idle_hours), "user_id long, at long", "Update", "EventTime")
    return out.select("user_id", F.timestamp_micros("at").alias("last_active_at"))


def credited_actions(stream: DataFrame, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, event_type, impression_id): each click (6 h) and purchase (2 d) with the newest impression before it.

    ``buckets`` should follow the rows of a trigger, of which a bucket's share meets in one call; a checkpoint keeps its number.
    """
    rows = _keyed(stream.where("event_type IN ('product_view', 'click', 'purchase') AND product_id IS NOT NULL AND user_id IS NOT NULL"), lateness)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id", "product_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        NewestImpression(), "event_id long, event_type string, impression_id long", "Append", "EventTime")


def buckets_for(rows: int) -> int:
    """Buckets for a trigger of so many rows."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))
