"""Any model behind one batch function: candidate generation and judging.

The function gets a list of texts and returns one reply per text. Only the text
crosses to Python, in Arrow batches; all other columns stay in the JVM.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Optional

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator, BarrierTaskContext
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType

from quillspark.functions.text import fill, lead_words, scored_text
from quillspark.operators.filters import nonnull
from quillspark.session import fresh_path, remove, shuffle_width

BatchFunction = Callable[[Sequence[str]], Sequence[Optional[str]]]
_LABELLED = StructType([StructField("label", StringType()), StructField("score", DoubleType())])
CandidateFunction = Callable[[Sequence[str], Sequence[int]], Sequence[Optional[str]]]

# Tries per call.
TRIES = 3
DEFAULT_CANDIDATES = 3

# Bytes of texts that one of the tasks that share a quota gets, as long as there are slots for more tasks.
QUOTA_TASK_BYTES = 32 << 20

# Bytes of texts that such a task gets at most, about: with more, they are asked in waves.
QUOTA_WAVE_BYTES = 128 << 20

# Errors that may pass: the call is made again. Any other error is the call's own.
TRANSIENT = (ConnectionError, TimeoutError)


class _Calls:
    """Calls of one task, with the error of each row that failed."""

    def __init__(self, fn: Callable, tries: int, transient: tuple[type[Exception], ...]):
        self.fn, self.tries, self.transient = fn, tries, transient
        self.errors: list[str | None] = []  # of the rows of the last batch

    def _once(self, columns: list[list]) -> list:
        found = list(self.fn(*columns))
        if len(found) != len(columns[0]):
            raise ValueError(f"{len(found)} replies to {len(columns[0])} texts")
        return found

    def __call__(self, columns: list[list]) -> list:
        """Replies to a batch; a failed row is null.

        A transient error is tried again and then fails the batch: the service is
        down, and asking it row by row would not help. Another error is narrowed
        down by halving the batch, so k bad rows of n cost about k log n calls.
        """
        self.errors = []
        return self._narrowed(columns)

    def _narrowed(self, columns: list[list]) -> list:
        rows = len(columns[0])
        for _ in range(self.tries):
            try:
                found = self._once(columns)
                self.errors += [None] * rows
                return found
            except self.transient as error:
                seen = error
            except Exception as error:
                seen = error
                if rows > 1:
                    half = rows // 2
                    return self._narrowed([c[:half] for c in columns]) + self._narrowed([c[half:] for c in columns])
                break
        self.errors += [repr(seen)] * rows
        return [None] * rows


class Outcome:
    """How many calls of a whole job failed; known when the job has run.

    The share is the job's, so it does not depend on how rows are dealt to tasks.
    """

    def __init__(self, name: str = "calls"):
        self.seen = Observation(f"{name}-{uuid.uuid4().hex}")

    def watch(self, df: DataFrame, error: Column, asked: Column) -> DataFrame:
        return df.observe(self.seen, F.count_if(asked).alias("asked"), F.count(error).alias("failed"), F.max(error).alias("error"))

    def check(self, most: float = 1.0) -> None:
        """Raise if the share of failed calls is ``most`` or more: that is no matter of single texts."""
        found = self.seen.get
        if found["asked"] and found["failed"] >= most * found["asked"]:
            raise RuntimeError(f"{found['failed']} of {found['asked']} calls failed, one with {found['error']}")


def _asking(fn: Callable, kind: DataType, tries: int, transient: tuple[type[Exception], ...]) -> Callable:
    """A function of columns to ``reply`` and ``error``; rows with a null in any column are not asked."""

    @F.pandas_udf(StructType([StructField("reply", kind), StructField("error", StringType())]))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        calls = _Calls(fn, tries, transient)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)  # one column comes by itself
            asked = pd.concat(columns, axis=1).notna().all(axis=1).to_numpy()
            replies, errors = [None] * len(asked), [None] * len(asked)
            if asked.any():
                found = calls([column[asked].tolist() for column in columns])
                for place, reply, error in zip(asked.nonzero()[0], found, calls.errors):
                    replies[place], errors[place] = reply, error
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run.asNondeterministic()


def asked(df: DataFrame, fn: Callable, columns: Sequence[Column], kind: DataType = StringType(), out: str = "reply",
          tries: int = TRIES, transient: tuple[type[Exception], ...] = TRANSIENT, outcome: Outcome | None = None) -> DataFrame:
    """Adds the function's reply to each row; failures are null and counted by ``outcome``."""
    made = df.withColumn("_asked", _asking(fn, kind, tries, transient)(*columns))
    if outcome is not None:
        whole = F.lit(True)
        for column in columns:
            whole = whole & column.isNotNull()
        made = outcome.watch(made, F.col("_asked.error"), whole)
    return made.withColumn(out, F.col("_asked.reply")).drop("_asked")


def replies(fn: BatchFunction, text: Column, tries: int = TRIES,
            transient: tuple[type[Exception], ...] = TRANSIENT) -> Column:
    """The function's reply to each text; a null text or a failure gives null."""
    return _asking(fn, StringType(), tries, transient)(text)["reply"]


def _number(scorer: Callable[[Sequence[str]], Sequence[float]]) -> Callable:
    return lambda texts: [None if value is None else float(value) for value in scorer(texts)]


def score_text(df: DataFrame, scorer: Callable[[Sequence[str]], Sequence[float]], text: Column,
               out: str = "score", tries: int = TRIES,
               transient: tuple[type[Exception], ...] = TRANSIENT, outcome: Outcome | None = None) -> DataFrame:
    """A number per text from an outside scorer, in batches; failures are null."""
    return asked(df, _number(scorer), [text], DoubleType(), out, tries, transient, outcome)


def label_text(df: DataFrame, classifier: Callable[[Sequence[str]], Sequence[tuple[str, float]]], text: Column,
               label: str = "label", score: str = "score", tries: int = TRIES,
               transient: tuple[type[Exception], ...] = TRANSIENT, outcome: Outcome | None = None) -> DataFrame:
    """A label and its score per text from an outside classifier, in batches; failures are null."""

    def named(texts: Sequence[str]) -> list:
        return [None if found is None else {"label": found[0], "score": found[1]} for found in classifier(texts)]

    made = asked(df, named, [text], _LABELLED, "_labelled", tries, transient, outcome)
    return made.withColumns({label: F.col("_labelled.label"), score: F.col("_labelled.score")}).drop("_labelled")


class _Superseded(BaseException):
    """Ends a task whose texts another attempt asks; no failure of a call."""


class Allowance:
    """At most ``calls`` texts in any ``period`` seconds, whatever the batches: a window slides over the calls sent.

    ``used`` of them count as sent just now.
    """

    def __init__(self, calls: int, period: float, sleep: Callable[[float], None] = time.sleep, used: int = 0):
        if calls < 1:
            raise ValueError("an allowance needs a call")
        self.calls, self.period, self.sleep = calls, period, sleep
        self.sent: deque[tuple[float, int]] = deque([(time.monotonic(), used)] if used else [])
        self.used = used

    def take(self, n: int) -> None:
        """Wait until ``n`` more texts may be sent."""
        while True:
            now = time.monotonic()
            while self.sent and now - self.sent[0][0] >= self.period:
                self.used -= self.sent.popleft()[1]
            if self.used + n <= self.calls:
                self.sent.append((now, n))
                self.used += n
                return
            self.sleep(self.sent[0][0] + self.period - now)

    def limited(self, fn: Callable) -> Callable:
        """``fn`` asked in batches that the allowance holds."""

        def ask(texts: Sequence, *rest: Sequence) -> list:
            out: list = []
            for at in range(0, len(texts), self.calls):
                part = slice(at, at + self.calls)
                self.take(len(texts[part]))
                out += list(fn(texts[part], *[column[part] for column in rest]))
            return out

        return ask


def throttled(fn: Callable, per_minute: float) -> Callable:
    """Keep one task below a number of texts per minute, evenly paced; a batch larger than that is cut.

    Tasks do not know of each other: see ``scored_under_quota`` for the quota of a service.
    """
    allowance = Allowance(max(1, int(per_minute)), 60.0)

    def slow(texts, *rest):
        start = time.monotonic()
        found = allowance.limited(fn)(texts, *rest)
        time.sleep(max(0.0, 60.0 * len(texts) / per_minute - (time.monotonic() - start)))
        return found

    return slow


def scored_under_quota(df: DataFrame, scorer: Callable[[Sequence[str]], Sequence[float]], text: str, quota: int,
                       period: float = 60.0, out: str = "score", tasks: int | None = None, tries: int = TRIES,
                       transient: tuple[type[Exception], ...] = TRANSIENT, keep: Sequence[str] | None = None) -> DataFrame:
    """A number per text from a service that allows ``quota`` texts in any ``period`` seconds, all tasks together.

    The tasks start together, as a barrier stage, and tell each other whether they
    have texts to ask; the quota is shared by those that do. A task never has more than its share in
    any period, and calls that are tried again count again. Before its first call an attempt leaves a mark in
    the shared folder. When the tasks are run again, as a whole after a failure or by another action, they leave
    their own mark and let a whole period pass; tasks of the attempt before that still run stop at it before
    their next call. So calls of two attempts never fall into one period.

    Needs as many free slots as ``tasks``, which never exceed the quota. If not given, these are four, and more if each
    would get more than ``QUOTA_TASK_BYTES`` of texts, up to the cluster's slots. If each would still get more than
    ``QUOTA_WAVE_BYTES``, the rows are dealt to waves that are asked and written one after the other, before this returns.

    ``keep`` are the columns of the result beside the score; if not given, all.
    """
    if quota < 1:
        raise ValueError("a quota needs a call")
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if tasks is None:
        tasks = max(4, -(-size // QUOTA_TASK_BYTES))
    width = min(tasks, df.sparkSession.sparkContext.defaultParallelism, quota)
    asking = partial(_asked_together, scorer=scorer, text=text, quota=quota, period=period, out=out, width=width, tries=tries,
                     transient=transient, keep=keep)
    waves = -(-size // (width * QUOTA_WAVE_BYTES))
    return _in_waves(df, rows, waves, quota, period, asking) if waves > 1 else asking(df)


def _in_waves(df: DataFrame, rows: int, waves: int, quota: int, period: float, asking: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``df``, asked in waves; a wave counts what those before it have sent in the last period."""
    spark = df.sparkSession
    parts, done = fresh_path(spark, "quota-parts"), fresh_path(spark, "quota-done")
    # A task deals runs of its rows to the waves in turn, so a wave gets a like part of any input, in few files.
    at, run = F.monotonically_increasing_id(), -(-rows // (8 * waves))
    turn = F.shiftright(at, 33) + F.floor(at.bitwiseAND((1 << 33) - 1) / run)
    df.withColumn("_wave", (turn % waves).cast("int")).write.partitionBy("_wave").parquet(parts)
    dealt = spark.read.schema(StructType([*df.schema.fields, StructField("_wave", IntegerType())])).parquet(parts)
    ended: list[tuple[float, int]] = []
    for wave in range(waves):
        now, sent = time.monotonic(), spark.sparkContext.accumulator(0)
        recent = min(quota, sum(n for then, n in ended if now - then < period))
        made = asking(dealt.filter(F.col("_wave") == wave).drop("_wave"), recent=recent, sent=sent)
        made.write.mode("append").parquet(done)
        ended.append((time.monotonic(), sent.value))
    remove(spark, parts)
    return spark.read.schema(made.schema).parquet(done)


def _asked_together(df: DataFrame, scorer: Callable[[Sequence[str]], Sequence[float]], text: str, quota: int, period: float, out: str,
                    width: int, tries: int, transient: tuple[type[Exception], ...], keep: Sequence[str] | None, recent: int = 0,
                    sent: Accumulator[int] | None = None) -> DataFrame:
    """One barrier stage of ``width`` tasks; ``recent`` texts of the quota count as sent just now, ``sent`` counts those of this stage."""
    spread = df.repartition(width)
    at, folder = spread.columns.index(text), fresh_path(df.sparkSession, "quota")
    kept_at = range(len(spread.columns)) if keep is None else [spread.columns.index(name) for name in keep]
    schema = StructType([*[spread.schema.fields[k] for k in kept_at], StructField(out, DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        first = next(batches, None)
        marks = _Marks(folder)
        before = marks.seen()
        told = context.allGather(f"{first is not None and first.num_rows > 0} {before != set()} {uuid.uuid4().hex}")
        busy = [found.startswith("True") for found in told]
        if first is None:
            return
        own = told[0].split()[2]
        marks.leave(own)
        if any(found.split()[1] == "True" for found in told):
            time.sleep(period)
        asked_service = _number(scorer)

        def ask(texts: Sequence[str]) -> list:
            now = marks.seen()
            if before is not None and now is not None and now - before - {own}:
                raise _Superseded("another attempt at these texts has begun")
            if sent is not None:
                sent.add(len(texts))
            return asked_service(texts)

        # Shares differ by one at most and add up to the quota, or to what is left of it in the first period.
        rank, n = sum(busy[: context.partitionId()]), max(1, sum(busy))
        share, left = (calls // n + (rank < calls % n) for calls in (quota, quota - recent))
        allowance = Allowance(share, period, used=share - left)
        calls = _Calls(allowance.limited(ask), tries, transient)
        for batch in itertools.chain([first], batches):
            texts = batch.column(at).to_pylist()
            asked_at = [k for k, value in enumerate(texts) if value is not None]
            values: list = [None] * len(texts)
            if asked_at:
                for k, value in zip(asked_at, calls([[texts[k] for k in asked_at]])):
                    values[k] = value
            columns = [*[batch.column(k) for k in kept_at], pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # A barrier stage is only run again if its rows go into a shuffle: one that ends the job fails it.
    return spread.mapInArrow(run, schema, barrier=True).repartition(width)


class _Marks:
    """The attempts at a job that have begun to ask, each a folder in one that all tasks see.

    Where a store can't be reached from tasks, nothing is known: every attempt then waits a
    period, and one that was given up is not stopped.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)

    def seen(self) -> set[str] | None:
        try:
            store, path = self._open()
            return {f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))}
        except (OSError, pa.ArrowException):
            return None

    def leave(self, name: str) -> None:
        try:
            store, path = self._open()
            store.create_dir(f"{path}/{name}", recursive=True)
        except (OSError, pa.ArrowException):
            pass


def candidate_replies(fn: CandidateFunction, prompt: Column, cand_idx: Column,
                      tries: int = TRIES, transient: tuple[type[Exception], ...] = TRANSIENT) -> Column:
    return _asking(fn, StringType(), tries, transient)(prompt, cand_idx)["reply"]


def fan_out(df: DataFrame, n_gens: int = DEFAULT_CANDIDATES, prompt: str = "prompt",
            max_words: int | None = None) -> DataFrame:
    """One row per prompt and candidate number; null prompts drop, long ones may be cut."""
    if n_gens < 1:
        raise ValueError("n_gens must be at least 1")
    kept = nonnull(df, prompt)
    if max_words is not None:
        kept = kept.withColumn(prompt, lead_words(F.col(prompt), max_words))
    return kept.withColumn("cand_idx", F.explode(F.array(*[F.lit(i) for i in range(n_gens)])))


def generate(df: DataFrame, generator: CandidateFunction, n_gens: int = DEFAULT_CANDIDATES,
             prompt: str = "prompt", max_words: int | None = None, keep_failed: bool = False,
             outcome: Outcome | None = None) -> DataFrame:
    """The long candidate table; candidates that failed are dropped, or kept with a null ``gen``."""
    # Model calls dominate, so prompts are dealt out evenly, equal ones too, before each is copied for its candidates.
    wanted = fan_out(nonnull(df, prompt).repartition(shuffle_width(df.sparkSession)), n_gens, prompt, max_words)
    made = asked(wanted, generator, [F.col(prompt), F.col("cand_idx")], out="gen", outcome=outcome)
    return made if keep_failed else made.filter(F.col("gen").isNotNull())


def judge(cands: DataFrame, judge_fn: BatchFunction, template: str, n: int = 1,
          include_prompt: bool = True, outcome: Outcome | None = None) -> DataFrame:
    """Fill the template with each of the first n candidates and ask the judge."""
    chosen = cands.filter(F.col("cand_idx") < n)
    question = fill(template, scored_text(F.col("prompt"), F.col("gen"), include_prompt))
    return asked(chosen.withColumn("_question", question), judge_fn, [F.col("_question")], out="response",
                 outcome=outcome).drop("_question")
