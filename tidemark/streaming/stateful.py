"""Updating aggregates of streams with a state for each key: retractions in and out, idle keys retracted and forgotten.

The input may carry _updating_meta; so does the output, as retract / append rows, so that one such aggregate can read another. Rows are combined
by key within each Arrow batch before the shuffle: a hot key costs a row for each batch of its rows. Counts, sums and averages
are kept as totals. Minimum, maximum and distinct count of an input that can be retracted need each value's count, walked only if the key changes: up to
INLINE values are part of the key's own state, so that a key is read and written once a batch, and more are held in the state store
beside the key, each read and written by itself; of append-only input the extreme itself is enough. Sums of doubles are added and taken
away again, so that rounding errors stay until a key has no rows; DECIMAL is exact. A row's retraction must not come in an earlier batch than the row."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import debezium, updating
from ..operators.windows import micros

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
META = "_updating_meta"
#: Values of a key up to which their counts are in the key's own state; the result is the same.
INLINE = 4096
NAN = float("nan")
#: function -> the function of the batch engine, which fixes its type
FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


class _Aggregate(StatefulProcessor):
    """State "totals": rows, time of the last change, whether a row is out, that row's values, then each slot's. "values<i>": a value's count,
    of slots with more than INLINE values. Other slots with values have them and their counts, pickled, in the totals; b"" there: they are in "values<i>"."""

    def __init__(self, slots: list[tuple[str, str]], types: list[T.DataType], held: list[T.DataType], names: list[str], ttl: int | None):
        self.slots, self.types, self.held, self.names, self.ttl, self.inline = slots, types, held, names, ttl, INLINE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("n", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("out", T.BooleanType())]
        fields += [T.StructField(f"o{i}", t) for i, t in enumerate(self.types)]
        for i, (_, how) in enumerate(self.slots):
            fields += [T.StructField(f"t{i}", T.BinaryType() if how == "values" else self.held[i]), T.StructField(f"c{i}", T.LongType())]
        self.totals = handle.getValueState("totals", T.StructType(fields))
        count = T.StructType([T.StructField("n", T.LongType())])
        self.values = {i: handle.getMapState(f"values{i}", T.StructType([T.StructField("v", self.held[i])]), count) for i, (_, how) in enumerate(self.slots) if how == "values"}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        k = len(self.types)
        state = self.totals.get()
        n, out, old, slots = (0, False, (), [[None, 0] for _ in self.slots]) if state is None else (state[0], state[2], tuple(state[3 : 3 + k]), [list(state[3 + k + 2 * i : 5 + k + 2 * i]) for i in range(len(self.slots))])
        changed: dict[int, dict] = {i: {} for i in self.values}
        for row in rows:
            n += row["_n"]
            for i, (function, how) in enumerate(self.slots):
                if how == "rows":
                    continue
                value, slot = row[f"_t{i}"], slots[i]
                slot[1] += row[f"_c{i}"] or 0
                if value is None:
                    continue
                if how == "total":
                    slot[0] = value if slot[0] is None else slot[0] + value
                elif how == "extreme":
                    slot[0] = value if slot[0] is None else min(slot[0], value) if function == "min" else max(slot[0], value)
                else:
                    value = value if value == value else NAN  # one key of a dict
                    changed[i][value] = changed[i].get(value, 0) + row[f"_c{i}"]
        live = {i: self._changed(i, slots[i], counts) for i, counts in changed.items()}
        new = tuple(self._value(i, n, slots[i], live.get(i)) for i in range(k)) if n > 0 else ()
        yield from self._events(key, out, old, n > 0, new)
        if n == 0 and not any(s[1] or s[0] and not isinstance(s[0], float) for s in slots) and all(next(v.iterator(), None) is None for i, v in self.values.items() if slots[i][0] == b""):
            self._forget()
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        self.totals.update((n, now, n > 0, *(new or (None,) * k), *(x for s in slots for x in s)))
        if self.ttl and state is None:
            self.handle.registerTimer(now + self.ttl)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.totals.get()
        if state is None:
            return
        due, now = state[1] + self.ttl, timerValues.getCurrentProcessingTimeInMs()
        if due > now:  # changed since the timer was set
            self.handle.registerTimer(due)
            return
        yield from self._events(key, state[2], tuple(state[3 : 3 + len(self.types)]), False, ())
        self._forget()

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        self.totals.clear()
        for v in self.values.values():
            v.clear()

    def _changed(self, i: int, slot: list, counts: dict) -> dict | None:
        """The slot's values and their counts once these counts are added, None if they are in the state store beside the key."""
        if slot[0] != b"":
            had = {} if slot[0] is None else {v if v == v else NAN: c for v, c in pickle.loads(slot[0]).items()}
            for value, c in counts.items():
                had[value] = had.get(value, 0) + c
                if not had[value]:
                    del had[value]
            if len(had) <= self.inline:
                slot[0] = pickle.dumps(had) if had else None
                return had
            slot[0] = b""
            for value, c in had.items():
                self.values[i].updateValue((value,), (c,))
            return None
        for value, c in counts.items():
            had = self.values[i].getValue((value,)) if self.values[i].containsKey((value,)) else (0,)
            if had[0] + c:
                self.values[i].updateValue((value,), (had[0] + c,))
            elif had[0]:
                self.values[i].removeKey((value,))
        return None

    def _value(self, i: int, n: int, slot: list, held: dict | None):
        function, how = self.slots[i]
        if how == "rows":
            return n
        if function == "count":
            return slot[1]
        if how == "values":
            live = (v[0] for v, c in self.values[i].iterator() if c[0] > 0) if held is None else (v for v, c in held.items() if c > 0)
            return sum(1 for _ in live) if function == "count_distinct" else (min if function == "min" else max)(live, default=None)
        if how == "extreme":
            return slot[0]
        if slot[1] <= 0:
            return None
        if function == "sum":
            return slot[0]
        if isinstance(self.types[i], T.DecimalType):
            return (slot[0] / slot[1]).quantize(Decimal(1).scaleb(-self.types[i].scale), ROUND_HALF_UP)
        return slot[0] / slot[1]

    def _events(self, key: tuple, out: bool, old: tuple, shown: bool, new: tuple) -> Iterator[Row]:
        if out and shown and all(a == b or (a != a and b != b) for a, b in zip(old, new)):
            return
        if out:
            yield Row(*self.names)(*key, *old, True)
        if shown:
            yield Row(*self.names)(*key, *new, False)


def _combined(df: DataFrame, by: list[str], sums: list[str], least: list[str], most: list[str]) -> DataFrame:
    """Rows of each Arrow batch put together by their keys; a stateless map, so that a stream may have it before its state."""
    plain = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    if any(isinstance(df.schema[c].dataType, plain) for c in by):
        return df
    names, how = df.columns, [*((c, "sum") for c in sums), *((c, "min") for c in least), *((c, "max") for c in most)]

    def combine(batches):
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b])
            g = t.group_by(by).aggregate(how)
            g = g.rename_columns([*by, *(c for c, _ in how)]) if g.column_names[: len(by)] == by else g.rename_columns([*(c for c, _ in how), *by])
            yield from g.select(names).cast(t.schema).to_batches()

    return df.mapInArrow(combine, df.schema)


def updating_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], ttl: str | None = None) -> DataFrame:
    """keys, aggregates and _updating_meta of a stream: a key that changes gives a retraction of its old row and its new row.

    aggs: name -> (function, column), functions as in FUNCTIONS; column None counts rows. Null keys are a key; no keys, one row once there is
    input. Unchanged rows are silent, keys whose rows are all gone only retract. ttl: keys idle for so long (processing time, seen at the next
    batch) are retracted and start anew; run_to_end then needs
    empty_batches=False. Run it in append mode."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    retracts = META in df.columns
    empty = spark.createDataFrame([], df.schema)
    slots, held, columns, sums, least, most, values = [], [], [], ["_n"], [], [], []
    for i, (function, c) in enumerate(aggs.values()):
        if function not in FUNCTIONS:
            raise ValueError(f"no updating aggregate {function} on streams")
        if c is None:
            slots.append((function, "rows"))
            held.append(T.LongType())
            continue
        kept = function in ("min", "max") and not retracts
        how = "extreme" if kept else "values" if function in ("min", "max", "count_distinct") else "total"
        kind = T.LongType() if function == "count" else empty.agg(F.sum(c)).schema[0].dataType if how == "total" else df.schema[c].dataType
        slots.append((function, how))
        held.append(kind)
        value = F.col(c) if how != "total" else (F.lit(0) if function == "count" else F.col(c) * F.col("_n"))
        columns += [value.cast(kind).alias(f"_t{i}"), F.when(F.col(c).isNotNull(), F.col("_n")).otherwise(F.lit(0)).cast("long").alias(f"_c{i}")]
        sums.append(f"_c{i}")
        (sums if how == "total" else values if how == "values" else least if function == "min" else most).append(f"_t{i}")
    by = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    x = df.withColumn("_n", (updating.sign() if retracts else F.lit(1)).cast("long"))
    x = x.select(*([F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k0")]), "_n", *columns)
    x = _combined(x, [*by, *values], sums, least, most)
    types = [empty.agg(FUNCTIONS[f]("*" if c is None else c)).schema[0].dataType for f, c in aggs.values()]
    result = T.StructType([*(T.StructField(b, x.schema[b].dataType) for b in by), *(T.StructField(f"_o{i}", t) for i, t in enumerate(types)), T.StructField("_r", T.BooleanType())])
    processor = _Aggregate(slots, types, held, result.names, micros(ttl) // 1000 if ttl else None)
    x = x.groupBy(*by).transformWithState(processor, result, "Append", "ProcessingTime" if ttl else "None")
    names = [*(F.col(b).alias(k) for b, k in zip(by, keys)), *(F.col(f"_o{i}").alias(n) for i, n in enumerate(aggs))]
    return x.select(*names, F.struct(F.col("_r").alias("is_retract"), debezium.row_id(by).alias("id")).alias(META))


def to_changelog(out: str, keys: list[str], fmt: str = "parquet", form=None):
    """A sink of retract / append rows: c, u and d events, at most one a key of each batch, in a folder of the batch's number."""

    def sink(batch: DataFrame, number: int) -> None:
        order = f"{META}.is_retract"
        events = debezium.encode(batch.withColumn("_order", F.when(F.col(order), 0).otherwise(1)), keys, ["_order"])
        (form(events) if form else events).write.mode("overwrite").format(fmt).save(f"{out}/batch={number}")

    return sink
