"""Published tables: a batch is written aside and becomes visible with one commit.

Rows lie under ``data/batch=<key>/attempt=<key>``; a commit is one small file in ``log``, numbered
without gaps, that names the attempt each batch is read from. Writing a batch again therefore
replaces it, however often a job is repeated, and readers see the old or the new attempt, never
parts of one. Ids are no part of the files: a row holds its place within its attempt, and the
commit that makes the attempt visible gives it the next range of ids. Two writers race for the next
number of the log only; the loser takes the range after the winner's.

A commit must not overwrite one that exists: the log relies on the file system's rename refusing
that atomically, as HDFS does; writers of one process also take turns.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TURN = threading.Lock()
_PLACE, _BATCH, _ATTEMPT, _TASK, _FIRST = "_place", "_batch", "_attempt", "_task", "_first"
_IN_TASK = (1 << 33) - 1


@dataclass
class State:
    """What the newest commit says: its number, the live attempt of every batch, the next free id, the columns."""

    number: int = 0
    next_id: int = 1
    schema: str | None = None
    batches: dict[str, dict] = field(default_factory=dict)


class PublishedTable:
    def __init__(self, spark: SparkSession, folder: str, id_col: str = "ID", stamp_col: str = "CreatedAt"):
        self.spark, self.folder, self.id_col, self.stamp_col = spark, folder.rstrip("/"), id_col, stamp_col

    # -- commits

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, conf, lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{name}")

    def state(self) -> State:
        """The newest commit; it lists all live batches, so older ones are not read."""
        jvm, conf, path = self._files()
        folder = path("x").getParent()
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return State()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        newest = max((n for n in names if n.endswith(".json") and n[0].isdigit()), default=None)
        if newest is None:
            return State()
        stream = fs.open(path(newest))
        try:
            return State(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, state: State) -> bool:
        """Whether this became commit ``state.number``; False when another writer has it."""
        jvm, conf, path = self._files()
        aside, final = path(f".{uuid.uuid4().hex}"), path(f"{state.number:012d}.json")
        fs = final.getFileSystem(conf)
        with _TURN:
            if fs.exists(final):
                return False
            stream = fs.create(aside, True)
            try:
                stream.write(bytearray(json.dumps(asdict(state)).encode()))
            finally:
                stream.close()
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(aside, final, options)
            except Exception as refused:
                fs.delete(aside, False)
                if "FileAlreadyExistsException" not in str(refused):
                    raise
                return False
        return True

    def _change(self, change) -> State:
        while True:
            state = self.state()
            state.number += 1
            change(state)
            if self._commit(state):
                return state

    # -- writing

    def publish(self, df: DataFrame, batch: str, replace: bool = False) -> int:
        """Make ``df`` the rows of ``batch``; returns how many. ``replace`` drops all other batches.

        Columns go by name into the table's, which the first batch defines; a missing creation time is
        stamped. New batches get the ids after the highest given out. A batch that is published again
        keeps its ids if they suffice, else it gets new ones. An empty frame leaves an empty batch.
        """
        if not isinstance(df, DataFrame):
            raise TypeError(f"publish expects a DataFrame, got {type(df).__name__}")
        if not batch:
            raise ValueError("a batch needs a name")
        state = self.state()
        fitted = self._fit(df, T.StructType.fromJson(json.loads(state.schema)) if state.schema else None)
        place = {"batch": hashlib.sha256(batch.encode()).hexdigest()[:32], "attempt": uuid.uuid4().hex}
        where = f"batch={place['batch']}/attempt={place['attempt']}"
        fitted.withColumn(_PLACE, F.monotonically_increasing_id()).write.parquet(f"{self.folder}/data/{where}")
        written = self.spark.read.schema(f"{_PLACE} bigint").parquet(f"{self.folder}/data/{where}")
        counts = written.groupBy(F.shiftright(_PLACE, 33).cast("int").alias(_TASK)).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1))  # one row a task
        starts = counts.select(_TASK, "n", F.coalesce(before, F.lit(0)).alias("before"))
        starts.coalesce(1).write.parquet(f"{self.folder}/starts/{where}")
        rows = self._starts([where]).agg(F.sum("n")).first()[0] or 0

        def take(state: State) -> None:
            held = state.batches.get(batch)
            if state.schema is None:
                state.schema = fitted.schema.json()
            if replace:
                state.batches, state.next_id, held = {}, 1, None
            if held and held["rows"] >= rows:
                first = held["first"]
                state.batches[batch] = {**place, "first": first, "rows": held["rows"]}
            else:
                state.batches[batch] = {**place, "first": state.next_id, "rows": rows}
                state.next_id += rows

        self._change(take)
        return rows

    def clear(self) -> None:
        """Drop all batches; the columns stay, ids start again."""

        def drop(state: State) -> None:
            state.batches, state.next_id = {}, 1

        self._change(drop)

    def _fit(self, df: DataFrame, known: T.StructType | None) -> DataFrame:
        if self.stamp_col and self.stamp_col not in df.columns:
            df = df.withColumn(self.stamp_col, F.current_timestamp())
        if known is None:
            return df.drop(self.id_col)
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known]
        return df.select(*columns)

    # -- reading

    def _starts(self, wheres: list[str]) -> DataFrame:
        kinds = f"{_TASK} int, n bigint, before bigint, batch string, attempt string"
        paths = [f"{self.folder}/starts/{w}" for w in wheres]
        return self.spark.read.schema(kinds).option("basePath", f"{self.folder}/starts").parquet(*paths)

    def read(self, batches: Sequence[str] | None = None) -> DataFrame:
        """The rows of all live batches, or of the named ones, with their ids. Only their attempts are listed and scanned."""
        state = self.state()
        live = {name: b for name, b in state.batches.items() if batches is None or name in batches}
        if state.schema is None:
            raise ValueError(f"nothing was published under {self.folder}")
        columns = T.StructType.fromJson(json.loads(state.schema))
        if not live:
            whole = T.StructType([T.StructField(self.id_col, T.LongType()), *columns.fields])
            return self.spark.createDataFrame([], whole)
        wheres = [f"batch={b['batch']}/attempt={b['attempt']}" for b in live.values()]
        kept = T.StructType([*columns.fields, T.StructField(_PLACE, T.LongType())])
        kept = T.StructType([*kept.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
        paths = [f"{self.folder}/data/{w}" for w in wheres]
        rows = self.spark.read.schema(kept).option("basePath", f"{self.folder}/data").parquet(*paths)
        rows = rows.withColumnsRenamed({"batch": _BATCH, "attempt": _ATTEMPT}).withColumn(_TASK, F.shiftright(_PLACE, 33).cast("int"))
        firsts = [(b["attempt"], b["first"]) for b in live.values()]
        firsts = self.spark.createDataFrame(firsts, f"attempt string, {_FIRST} bigint")
        # One row a batch and task; Spark broadcasts them when they are few.
        starts = self._starts(wheres).join(firsts, "attempt")
        starts = starts.select(F.col("attempt").alias(_ATTEMPT), _TASK, (F.col(_FIRST) + F.col("before")).alias(_FIRST))
        own = F.col(_FIRST) + F.col(_PLACE).bitwiseAND(F.lit(_IN_TASK))
        return rows.join(starts, [_ATTEMPT, _TASK]).select(own.alias(self.id_col), *columns.names)

    def register(self, name: str) -> None:
        """Let ``spark.table(name)`` read what is published now."""
        self.read().createOrReplaceTempView(name)
