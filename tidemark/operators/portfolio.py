"""Sequential portfolio kernels: one group a strategy, the state machine inside.

Only what is sequential by nature runs here: slot acceptance and FIFO lots. Groups are
strategies, whose orders are few; everything before and after is declarative.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accept_by_slots(trades: DataFrame, slots: int, by: str = "strategy") -> DataFrame:
    """Trades (by, trade_id, entry_idx, exit_idx, score) that a book of ``slots`` takes.

    In order of entry, best score first, then trade_id; a slot is free again on its exit index.
    Of trades that occupy a slot, one behind ``slots`` others of its entry index can't be taken, so it is left out before
    the loop; a book's group is bounded by its entry days, and by trades that end where they begin.
    """
    floating = trades.schema["score"].dataType.simpleString() in ("double", "float")
    best = (F.nanvl("score", F.lit(None).cast("double")) if floating else F.col("score")).desc_nulls_last()
    occupies = F.coalesce(F.col("exit_idx") > F.col("entry_idx"), F.lit(True))
    place = F.row_number().over(Window.partitionBy(by, "entry_idx").orderBy(best, "trade_id"))
    first = trades.filter(occupies).withColumn("_place", place).filter(F.col("_place") <= slots).drop("_place")
    trades = first.unionByName(trades.filter(~occupies))

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["entry_idx", "score", "trade_id"], ascending=[True, False, True])
        busy: list[int] = []
        kept = []
        for entry, exit_ in zip(rows["entry_idx"], rows["exit_idx"], strict=True):
            busy = [b for b in busy if b > entry]
            kept.append(len(busy) < slots)
            if kept[-1]:
                busy.append(exit_)
        return rows[kept]

    return trades.groupBy(by).applyInPandas(take, trades.schema)


def fifo_lots(orders: DataFrame, by: str = "strategy") -> DataFrame:
    """(by, ticker, open_idx, close_idx, shares, pnl): lots closed first in, first out.

    Orders are (by, ticker, idx, seq, shares, price), shares negative for a sale. A sale takes at most
    what is held; what is open at the end is closed at the ticker's last price.
    """
    kinds = {f.name: f.dataType.simpleString() for f in orders.schema.fields}
    schema = f"{by} {kinds[by]}, ticker {kinds['ticker']}, open_idx bigint, close_idx bigint, shares double, pnl double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["idx", "seq"])
        held: dict[object, deque] = {}
        last: dict[object, tuple[int, float]] = {}
        out = []
        for ticker, idx, shares, price in zip(rows["ticker"], rows["idx"], rows["shares"], rows["price"], strict=True):
            last[ticker] = (idx, price)
            lots = held.setdefault(ticker, deque())
            if shares > 0:
                lots.append([idx, shares, price])
                continue
            left = -shares
            while left > 1e-12 and lots:
                part = min(left, lots[0][1])
                out.append((ticker, lots[0][0], idx, part, part * (price - lots[0][2])))
                lots[0][1] -= part
                left -= part
                if lots[0][1] <= 1e-12:
                    lots.popleft()
        for ticker, lots in held.items():
            for opened, shares, price in lots:
                out.append((ticker, opened, last[ticker][0], shares, shares * (last[ticker][1] - price)))
        found = pd.DataFrame(out, columns=["ticker", "open_idx", "close_idx", "shares", "pnl"])
        found.insert(0, by, rows[by].iloc[0])
        return found

    return orders.groupBy(by).applyInPandas(run, schema)
