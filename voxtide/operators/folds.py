"""Sequential folds spread over blocks.

Some rules have a state that no window can express. ``blocked_fold`` runs such a rule block by block: every block
starts from a guess (the initial state), each block's end state is compared with the start its successor assumed, and
the blocks that guessed wrong run again with the right start, until all agree or, after a fixed number of
rounds, the rest of a key runs in order. The result is exactly that of one pass in order. Keys that fit one block need one pass; the state must be small and must not grow with the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from voxtide.session import cut_lineage

# step(columns as lists, state, last) -> (emitted tuples, state)
Step = Callable[[dict[str, list], Any, bool], tuple[list[tuple], Any]]
# Rounds in which blocks run again from the states before them.
REPAIRS = 2


def _whole_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], output: StructType, step: Step, columns: Sequence[str]
) -> DataFrame:
    """One pass over each partition in key order, the state carried from batch to batch.

    The window marks the last row of each key; it also is what brings a key together and in order, sharing the shuffle
    of windows before it. No key is ever held whole.
    """
    schema = StructType([*[df.schema[k] for k in keys], *output.fields])
    arrow = to_arrow_schema(schema)
    needed = list(dict.fromkeys([*keys, *order, *columns]))
    window = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*needed, F.lead(F.lit(True)).over(window).isNull().alias("_last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            data = {name: batch.column(i).to_pylist() for i, name in enumerate(needed)}
            ends = [i + 1 for i, last in enumerate(batch.column(len(needed)).to_pylist()) if last]
            begin, out = 0, []
            for end in dict.fromkeys([*ends, batch.num_rows]):
                if begin == end:
                    continue
                last = bool(ends) and end <= ends[-1]
                emitted, state = step({name: data[name][begin:end] for name in columns}, state, last)
                key = [data[k][begin] for k in keys]
                out.extend((*key, *row) for row in emitted)
                begin, state = end, None if last else state
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def encode_state(state: Any) -> str:
    return json.dumps(state, separators=(",", ":"))


def blocked_fold(
    df: DataFrame,
    keys: Sequence[str],
    block: str | None,
    order: Sequence[str],
    output: StructType,
    step: Step,
    columns: Sequence[str],
) -> DataFrame:
    """Rows that ``step`` emits over each key's rows in order, plus the key columns.

    ``step(columns, state, last)`` gets consecutive rows in ``order`` as lists per column, the state before them (None
    at the start of the key) and whether the key ends with them; it returns the emitted tuples and the state after.
    Without a block every key is folded in one pass, and the plan stays lazy. With one, all blocks run at once from
    guessed starts, blocks whose guess was wrong run again at most ``REPAIRS`` times, and then the rest of a key
    that has still not settled runs in one ordered pass: the rounds do not grow with the number of blocks.
    """
    if block is None:
        return _whole_keys(df, keys, order, output, step, columns)
    key_fields = [df.schema[k] for k in (*keys, block)]
    names = [f.name for f in key_fields]
    schema = StructType(
        [
            *key_fields,
            StructField("_state_in", StringType()),
            StructField("_state_out", StringType()),
            StructField("_is_state", BooleanType()),
            *[StructField(f.name, f.dataType, True) for f in output.fields],
        ]
    )
    arrow, empty = to_arrow_schema(schema), [None] * len(output.names)
    needed = list(dict.fromkeys([*names, *order, *columns]))
    sent = [*needed, "_state_in", "_last", "_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_state: list = []
        for batch in batches:
            data = {name: batch.column(i).to_pylist() for i, name in enumerate(sent)}
            ends = [i + 1 for i, end in enumerate(data["_end"]) if end]
            begin, out = 0, []
            for end in dict.fromkeys([*ends, batch.num_rows]):
                if begin == end:
                    continue
                start, closes = data["_state_in"][begin], data["_end"][end - 1]
                state = open_state.pop() if open_state else (None if start is None else json.loads(start))
                last = closes and data["_last"][begin]
                emitted, state = step({name: data[name][begin:end] for name in columns}, state, last)
                head = [*(data[name][begin] for name in names), start]
                out.extend((*head, None, False, *row) for row in emitted)
                if closes:
                    out.append((*head, encode_state(state), True, *empty))
                else:
                    open_state.append(state)
                begin = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    rows = df.select(*needed)
    ends = rows.groupBy(*keys).agg(F.max(block).alias("_final"))
    rows = rows.join(ends, list(keys)).withColumn("_last", F.col(block) == F.col("_final")).drop("_final")
    window = Window.partitionBy(*names).orderBy(*order)

    def fold(source: DataFrame) -> DataFrame:
        return source.withColumn("_end", F.lead(F.lit(True)).over(window).isNull()).select(*sent).mapInArrow(run, schema)

    done = cut_lineage(fold(rows.withColumn("_state_in", F.lit(None).cast("string"))))
    before = Window.partitionBy(*keys).orderBy(block)
    for repairs in range(REPAIRS + 1):
        states = done.filter("_is_state").select(*names, "_state_in", F.lag("_state_out").over(before).alias("_want"))
        stale = states.filter(~F.col("_state_in").eqNullSafe(F.col("_want"))).select(
            *names, F.col("_want").alias("_state_in")
        )
        if stale.isEmpty():
            break
        stale = cut_lineage(stale)
        if repairs == REPAIRS:
            # States that do not meet by then may never do: what is left of such a key runs in one pass, from its
            # first stale block, whose start is known to be right.
            tails = stale.groupBy(*keys).agg(F.min(block).alias("_first"), F.min_by("_state_in", block).alias("_state_in"))
            tail = rows.join(tails, list(keys)).filter(F.col(block) >= F.col("_first"))
            tail = tail.withColumn(block, F.col("_first")).drop("_first").withColumn("_last", F.lit(True))
            kept = done.join(tails.select(*keys, "_first"), list(keys), "left")
            kept = kept.filter(F.col("_first").isNull() | (F.col(block) < F.col("_first"))).drop("_first")
            done = cut_lineage(kept.unionByName(fold(tail)))
            break
        kept = done.join(stale.select(*names), names, "left_anti")
        done = cut_lineage(kept.unionByName(fold(rows.join(stale, names))))
    return done.filter(~F.col("_is_state")).select(*keys, *output.names)
