"""Streams at scale: rows per key without data frames, few calls to state, micro-batches of several files."""

from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import rows_of
from riskloom.streaming import jobs
from riskloom.streaming.processors import AccountOwnerProcessor, OwnerProcessor, TakeoverProcessor
from riskloom.streaming.revisions import RevisingRiskProcessor
from riskloom.plans.queries import INDICATORS, SCORES


class State:
    """Stands in for a state variable, and counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.value, self.items = calls, None, {}

    def _called(self, name):
        self.calls[name] += 1

    def get(self):
        self._called("get")
        return self.value

    def exists(self):
        self._called("exists")
        return self.value is not None

    def update(self, value):
        self._called("update")
        self.value = value

    def clear(self):
        self._called("clear")
        self.value = None

    put = update

    def appendList(self, values):
        self._called("append")
        self.value = [*(self.value or []), *values]

    def getValue(self, key):
        self._called("get")
        return self.items.get(key)

    def updateValue(self, key, value):
        self._called("update")
        self.items[key] = value

    def iterator(self):
        self._called("iterator")
        return iter(self.items.items())


class Handle:
    def __init__(self):
        self.calls = Counter()

    def getValueState(self, name, *schema):
        return State(self.calls)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls["timer"] += 1

    deleteTimer = registerTimer


def begun(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle.calls


CHANGE = Row("from_account_id", "kind", "event_time", "event_id", "customer_id")


def test_an_account_with_one_change_asks_little_of_state():
    owner, calls = begun(OwnerProcessor(early=True))
    assert list(owner.handleInputRows(("a",), iter([CHANGE("a", 0, 5, "c", "c")]), None)) == []
    assert sum(calls.values()) == 2
    told = list(owner.handleInputRows(("a",), iter([CHANGE("a", 1, 9, "e1", None), CHANGE("a", 1, 3, "e2", None)]), None))
    assert [(r.event_id, r.customer_id) for r in told] == [("e1", "c"), ("e2", None)]
    # A change that comes late alters one answer.
    told = list(owner.handleInputRows(("a",), iter([CHANGE("a", 0, 2, "b", "b")]), None))
    assert [(r.event_id, r.customer_id) for r in told] == [("e2", "b")]


OWNED = Row("account_id", "kind", "event_time", "customer_id", "row_id", "amount")


def test_a_new_owner_asks_little_of_state():
    owner, calls = begun(AccountOwnerProcessor(hold=10))
    assert list(owner.handleInputRows(("a",), iter([OWNED("a", 0, 1, "c", None, None)]), None)) == []
    assert sum(calls.values()) == 3 and "iterator" not in calls
    told = list(owner.handleInputRows(("a",), iter([OWNED("a", 1, 4, None, "t", 2.0)]), None))
    assert [tuple(r) for r in told] == [("c", 4, "t", 2.0)]


def test_takeover_and_risk_rows():
    row = Row("customer_id", "event_type", "event_time", "row_id", "amount")
    matcher, _ = begun(TakeoverProcessor(within=100))
    rows = [row("c", "TRANSFER", 9, "3", 7.0), row("c", "LOGIN_FAILED", 1, "1", 0.0), row("c", "BENEFICIARY_ADD", 4, "2", 0.0)]
    assert [tuple(r) for r in matcher.handleInputRows(("c",), iter(rows), None)] == [("c", 1, 4, 9, 7.0)]
    names = ["identity_key", "event_time", *jobs.EVENT_FIELDS]
    risk, calls = begun(RevisingRiskProcessor(INDICATORS, SCORES, 10))
    event = Row(*names)(*["i", 5] + [None] * len(jobs.EVENT_FIELDS))
    assert list(risk.handleInputRows(("i",), iter([event]), None)) == []
    assert sum(calls.values()) == 6


def test_replayed_micro_batches_have_several_files(spark):
    """Rows of one micro-batch are in several files and still come together; one micro-batch may be empty."""
    df = spark.range(100).select((F.col("id") * 10).alias("t"), F.col("id").cast("string").alias("name"))
    feed = jobs.replayed(df, "t", [300, 2000], "t-files", file_rows=15)
    seen = []
    root = jobs.scratch(spark, "t-files")

    def keep(batch, epoch):
        rows = batch.select("t", F.input_file_name().alias("file")).collect()
        seen.append((len({r.file for r in rows}), sorted(r.t for r in rows)))

    feed.writeStream.option("checkpointLocation", root).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert [rows for _, rows in seen] == [list(range(0, 300, 10)), list(range(300, 1000, 10)), []]
    assert [files > 1 for files, _ in seen] == [True, True, False]
    none = jobs.replayed(df.limit(0), "t", [300], "t-none")
    assert rows_of(jobs.drain(none, "t-none")) == []


def test_held_rows_are_handed_over_in_blocks():
    names = ["identity_key", "event_time", *jobs.EVENT_FIELDS]
    risk, _ = begun(RevisingRiskProcessor(INDICATORS, SCORES, 10))
    event = Row(*names)
    rows = [event("i", t, "NEW_DEVICE", *[None] * (len(jobs.EVENT_FIELDS) - 1)) for t in range(2500)]
    told = list(risk.handleInputRows(("i",), iter(rows), None))
    assert len(risk.held.value) == 3 and [r["event_time"] for r in risk._held_rows()] == list(range(2500))
    said = {e["event_time"]: e["score"] for e in risk._held_rows() if e["score"] is not None}
    assert said and said == {r.event_time: r.score for r in told}
