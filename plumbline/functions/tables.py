"""Table functions for SQL, and user code over whole tables as data frames."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Frames = Iterator[pd.DataFrame]


class NumberSessions:
    """``number_sessions(TABLE(t), key column, time column, seconds)``: the rows of any table with a column ``session``.

    Sessions of a key count from 1; one ends where no row follows within the seconds. Rows without a time
    have a null session; rows without a key are one key. A table that has a column ``session`` is refused. Rows of a key
    stream through one task in time order, which keeps two numbers of them, whatever their number.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(rows.dataType, T.StructType):
            raise ValueError("number_sessions wants TABLE(...) first")
        names = {f.name.lower() for f in rows.dataType.fields}
        for given in (key, time):
            if given.value is None or given.value.lower() not in names:
                raise ValueError(f"number_sessions: no column {given.value}")
        if "session" in names:
            raise ValueError("number_sessions: the table has a column session")
        if seconds.value is None or seconds.value <= 0:
            raise ValueError("number_sessions: seconds must be positive")
        quoted = ["`" + c.value.replace("`", "``") + "`" for c in (key, time)]
        schema = T.StructType([*rows.dataType.fields, T.StructField("session", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(quoted[0])], orderBy=[OrderingColumn(quoted[1])])

    def __init__(self):
        self.last, self.session = None, 0

    def eval(self, row: T.Row, key: str, time: str, seconds: int):
        at = next(v for n, v in zip(row.__fields__, row) if n.lower() == time.lower())
        if at is None:
            yield (*row, None)
            return
        if self.last is None or at - self.last >= dt.timedelta(seconds=seconds):
            self.session += 1
        self.last = at
        yield (*row, self.session)


def register_table_functions(spark: SparkSession) -> None:
    """Make the library's table functions known to ``spark.sql``."""
    spark.udtf.register("number_sessions", F.udtf(NumberSessions))


def map_frames(df: DataFrame, fn: Callable[[Frames], Frames], schema: str, keys: Sequence[str] = (), merge: Callable[[Frames], Frames] | None = None) -> DataFrame:
    """User code over a whole table, which it sees as data frames, a batch at a time.

    Without ``keys`` the code sees one partition; with keys, all rows of one key in a task of its own, in batches too, so
    no key has to fit into memory. Code that keeps what it has seen must bound that itself. No rows: no call.

    With ``merge`` a key may hold much of the table: the code is called for the rows of a key in one batch, where they
    lie, and tells of them in rows of ``schema``; ``merge`` sees all rows told of a key and gives its result, of the same
    schema. No rows of the table are moved, and no task reads all rows of a key.
    """
    names = list(df.columns)
    # names with dots do not reach user code in Spark; positions do
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(f.set_axis(names, axis=1) for f in frames)

    # the evaluation is chosen by these hints, which must be types, not texts
    named.__annotations__ = {"frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    if not keys:
        return plain.mapInPandas(named, schema)
    if merge is None:
        return plain.groupBy(*[f"c{names.index(k)}" for k in keys]).applyInPandas(named, schema)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, rows in f.groupby("_key", sort=False):
                for out in fn(iter([rows.drop(columns="_key").set_axis(names, axis=1).reset_index(drop=True)])):
                    yield out.assign(_key=key)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from merge(f.drop(columns="_key") for f in frames)

    # keys as text: nulls and large numbers stay what they are
    text = F.to_json(F.struct(*[F.col(f"c{names.index(k)}").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    return map_frames(plain.withColumn("_key", text).mapInPandas(told, schema + ", _key string"), merged, schema, ["_key"])
