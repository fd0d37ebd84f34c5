"""Answers to inbox records as they come, and what becomes of records that nobody answers, by timers; neighbouring
records share their state and a timer.

Events: company_id, id, at (event time), kind ('record', 'action' or 'tick'), deadline (of a record: when its period is filed)
and answer (of an action). A record without an action by its deadline is deemed accepted then; the first action up to it
counts, later ones don't. Ticks only move the watermark on. Repeated events change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "company_id int, id bigint, at timestamp, kind string, deadline timestamp, answer string"
OUTCOME = "company_id int, id bigint, outcome string, at timestamp"
DEEMED = "deemed_accepted"
#: Milliseconds for which a decided record is remembered, so that an event that is repeated doesn't start it anew.
REMEMBERED = 400 * 86_400_000
#: A company's records whose ids agree but for so many last bits share their state, so what passes between Spark and Python is
#: whole blocks; a block has at most 4096 records, however many there are in all.
BLOCK_BITS = 12
# Spark first starts the processor in a Python of its own beside the driver, which doesn't get the context's files; so it is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Answers(StatefulProcessor):
    """State of a block of a company's records, one array a column: deadline (0 before the record itself has come), the first action
    so far, whether it is decided. `due` is the block's one timer: the earliest deadline, or end of remembering, of its records."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "ids array<bigint>, deadlines array<bigint>, acted array<bigint>, answers array<string>, decided array<boolean>, due bigint")

    def load(self) -> tuple[pd.DataFrame, int]:
        ids, deadlines, acted, answers, decided, due = self.block.get() if self.block.exists() else ([], [], [], [], [], 0)
        held = pd.DataFrame({"deadline": deadlines, "acted": acted, "decided": decided}, index=pd.Index(ids, dtype="int64"))
        return held.astype({"deadline": "int64", "acted": "int64", "decided": "bool"}).assign(answer=pd.Series(answers, index=held.index, dtype=object)), due

    def save(self, held: pd.DataFrame, due: int) -> None:
        """Writes a block that had its timer at `due`, 0 for none; an empty one is forgotten."""
        ends = held["deadline"].where(~held["decided"], held["deadline"] + REMEMBERED)[held["deadline"] > 0]
        then = int(ends.min()) if len(ends) else 0
        if then != due:
            if due:
                self.handle.deleteTimer(due)
            if then:
                self.handle.registerTimer(then)
        if len(held):
            columns = (held[c].tolist() for c in ("deadline", "acted", "answer", "decided"))
            self.block.update((held.index.tolist(), *columns, then))
        elif self.block.exists():
            self.block.clear()

    def outcome(self, key: tuple, held: pd.DataFrame, now: pd.Series) -> Iterator[pd.DataFrame]:
        """Marks the records that `now` holds for as decided and tells how."""
        made = held[now]
        held.loc[now, "decided"] = True
        if len(made):
            timely = made["answer"].notna() & (made["acted"] <= made["deadline"])
            at = pd.to_datetime(made["acted"].where(timely, made["deadline"]), unit="ms")
            told = {"id": made.index.to_numpy(), "outcome": made["answer"].where(timely, DEEMED).to_numpy(), "at": at.to_numpy()}
            yield pd.DataFrame({"company_id": pd.Series([key[0]] * len(made), dtype="Int32"), **told})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        millis = lambda t: ((t - pd.Timestamp(0)) // pd.Timedelta(1, "ms")).astype("int64")
        came = pd.concat(list(rows)).set_index("id")
        records, actions = came[came["kind"] == "record"], came[(came["kind"] == "action") & (came["answer"].fillna("") != "")]
        if not len(records) + len(actions):
            return
        held, due = self.load()
        new = records.index.union(actions.index).unique().difference(held.index)
        fresh = pd.DataFrame({"deadline": 0, "acted": 0, "decided": False, "answer": None}, index=new).astype(held.dtypes.to_dict())
        held = pd.concat([held, fresh]) if len(held) else fresh
        deadline = millis(records["deadline"]).groupby(level=0).last()
        first = pd.DataFrame({"acted": millis(actions["at"]), "answer": actions["answer"]})
        known = held.loc[held["answer"].notna(), ["acted", "answer"]]
        first = pd.concat([first, known[known.index.isin(first.index)]]).rename_axis("id").reset_index().sort_values(["id", "acted", "answer"]).drop_duplicates("id").set_index("id")
        deadline, first = deadline[~held["decided"].loc[deadline.index]], first[~held["decided"].loc[first.index]]
        held.loc[deadline.index, "deadline"] = deadline
        held.loc[first.index, "acted"] = first["acted"]
        held.loc[first.index, "answer"] = first["answer"]
        yield from self.outcome(key, held, ~held["decided"] & (held["deadline"] > 0) & held["answer"].notna())
        self.save(held, due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Decides all that is due by the watermark, so that a timer that waits behind this one isn't late."""
        if not self.block.exists():
            return
        held, _ = self.load()  # its timer is the one that has expired and that Spark takes away
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = held[~held["decided"] | (held["deadline"] + REMEMBERED > now)].copy()
        yield from self.outcome(key, held, ~held["decided"] & (held["deadline"] > 0) & (held["deadline"] <= now))
        self.save(held, 0)

    def close(self) -> None:
        pass


def answered(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The outcome of each record of a stream of events, as soon as it is certain; `late` is how far events may come out of order."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = events.withWatermark("at", late).where(F.col("id").isNotNull())
    return timed.withColumn("block", F.shiftright("id", BLOCK_BITS)).groupBy("company_id", "block").transformWithStateInPandas(statefulProcessor=Answers(), outputStructType=OUTCOME, outputMode="Update", timeMode="eventTime")
