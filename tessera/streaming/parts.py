"""Arrays that arrive in parts: keyed state, a watermark, and timeouts.

A stream brings parts of arrays: an array's key, the number of the part, how many parts the
array has, the time of the part and its cells. State holds an array's parts until the last one
is there; the array is emitted at once then. If the watermark passes the array's latest time
by ``patience`` first, what is there is emitted as cut short, with null cells in no place: the
parts that are missing are simply left out, and ``parts`` says which are there.

A part that arrives twice counts once, the first time. An array is emitted once: its key is
remembered, without cells, until its timeout, so repeated parts of a whole array make no second
one. Parts older than the watermark are dropped by Spark and can't complete an array; one whose
state is gone begins a new array, which is cut short in its turn. State is bounded by the
arrays in flight, and one array by its own size: use chunks as arrays where those are large.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schema import quoted


def assemble(stream: DataFrame, keys: Sequence[str], part: str, of: str, time: str, cells: str, patience: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(keys, complete, parts, values): an array for each key.

    ``part`` numbers an array's parts from 0, ``of`` tells how many it has; ``cells`` are a
    part's cells, in order. ``delay`` is the watermark's: how late a part may be."""
    # A cell travels in a struct of its own, so null cells and NaN stay apart in pandas.
    kind = T.ArrayType(T.StructType([T.StructField("v", stream.schema[cells].dataType.elementType)]))
    key_fields = [T.StructField(k, stream.schema[k].dataType) for k in keys]
    out = T.StructType([*key_fields, T.StructField("complete", T.BooleanType()), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("values", kind)])
    state = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("until", T.LongType()), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("cells", T.ArrayType(kind))])
    wait = pd.Timedelta(patience) // pd.Timedelta(milliseconds=1)

    def emitted(key: tuple, complete: bool, held: dict[int, list]) -> pd.DataFrame:
        order = sorted(held)
        row = (*key, complete, order, [{"v": x} for p in order for x in held[p]])
        return pd.DataFrame({f.name: [v] for f, v in zip(out.fields, row, strict=True)})

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        done, until, parts, values = group.get if group.exists else (False, 0, [], [])
        held = {p: [x[0] for x in c] for p, c in zip(parts, values, strict=True)}
        if group.hasTimedOut:
            group.remove()
            if not done:
                yield emitted(key, False, held)
            return
        wanted = None
        for batch in batches:
            for p, n, at, c in zip(batch["__part"], batch["__of"], batch["__time"], batch["__cells"], strict=True):
                held.setdefault(int(p), [x["v"] for x in c])
                wanted, until = int(n), max(until, at.value // 1_000_000 + wait)
        if not done and wanted is not None and all(p in held for p in range(wanted)):
            yield emitted(key, True, held)
            done, held = True, {}
        if done:
            held = {}
        order = sorted(held)
        group.update((done, until, order, [[(x,) for x in held[p]] for p in order]))
        group.setTimeoutTimestamp(max(until, group.getCurrentWatermarkMs() + 1))

    at = F.col("__time")
    named = stream.select(*map(quoted, keys), quoted(part).cast("int").alias("__part"), quoted(of).cast("int").alias("__of"), quoted(time).cast("timestamp").alias("__time"), F.transform(quoted(cells), lambda x: F.struct(x.alias("v"))).alias("__cells"))
    whole = named.where(F.col("__part").isNotNull() & F.col("__of").isNotNull() & at.isNotNull() & F.col("__cells").isNotNull())
    made = whole.withWatermark("__time", delay).groupBy(*map(quoted, keys)).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    return made.withColumn("values", F.transform("values", lambda x: x["v"]))
