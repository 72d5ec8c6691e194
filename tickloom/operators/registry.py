"""An append-only log of trials: every statistic is logged before it is shown. Many writers may log at once.

A batch of trials is staged as a table of its own. Its ids are then claimed by a numbered file that names the batch, its first id and
its size. A claim's number is the one after the last claim's, and only one writer can make the file of a number: the others read the new last
claim and try again. Batches without a claim (of a writer that was lost) are never read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.ranks import numbered
from tickloom.sources.shared import kept

#: The columns and statuses of a trial.
COLUMNS = (
    "trial_id", "logged_at", "script", "question", "ticker", "date", "clock", "bucket", "horizon", "window", "split",
    "n_obs", "metric", "value", "status", "note",
)
STATUSES = ("descriptive", "predictive", "abandoned")
_SCHEMA = ", ".join(f"`{c}` {'bigint' if c == 'trial_id' else 'string'}" for c in COLUMNS)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _made_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that is there whole or not at all; False where another writer has made it."""
    store, place = _folder(spark, path)
    if place.toUri().getScheme() in (None, "file"):
        part = f"{place.toUri().getPath()}.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            f.write(text)
        try:
            os.link(part, place.toUri().getPath())  # fails where there is one
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = store.create(part)
    out.writeBytes(text)
    out.close()
    return store.rename(part, place)  # a rename onto a file that is there does nothing and says so


def _last_claim(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number of the last claim, first free id)."""
    store, place = _folder(spark, f"{path}/claims")
    names = [s.getPath().getName() for s in store.listStatus(place)]
    last = max((n for n in names if n.isdigit()), default=None)
    if last is None:
        return 0, 1
    stream = store.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{last}"))
    _, first, count = stream.readLine().split(" ")
    stream.close()
    return int(last), int(first) + int(count)


def _claimed(spark: SparkSession, path: str, batch: str, count: int) -> int:
    """The first id of a staged batch."""
    store, place = _folder(spark, f"{path}/claims")
    store.mkdirs(place)
    while True:
        number, first = _last_claim(spark, path)
        if _made_once(spark, f"{path}/claims/{number + 1:010d}", f"{batch} {first} {count}"):
            return first


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """All trials; a gap or repeat in the ids fails the query. A registry that is not there yet is empty."""
    store, place = _folder(spark, f"{path}/claims")
    if not store.exists(place):
        return spark.createDataFrame([], _SCHEMA)
    part = F.split("value", " ")
    number = F.col("_metadata.file_name").cast("bigint").alias("number")
    claims = spark.read.option("pathGlobFilter", "[0-9]*[0-9]").text(f"{path}/claims")
    claims = claims.select(number, part[0].alias("batch"), part[1].cast("bigint").alias("first"), part[2].cast("bigint").alias("count"))
    kinds = ", ".join(f"`{c}` string" for c in COLUMNS[1:])
    rows = spark.read.schema(f"batch string, n bigint, {kinds}").option("recursiveFileLookup", "true").parquet(f"{path}/batches")
    before = claims.select((F.col("number") + 1).alias("number"), (F.col("first") + F.col("count")).alias("next"))
    there = rows.groupBy("batch").agg(F.count("*").alias("rows"))
    checked = claims.join(before, "number", "left").join(there, "batch", "left")
    good = (F.col("first") == F.when(F.col("number") == 1, 1).otherwise(F.coalesce("next", F.lit(-1)))) & (F.coalesce("rows", F.lit(0)) == F.col("count"))
    checked = checked.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("trial ids do not run from 1 without gaps")).cast("boolean")))
    trial = (F.col("first") + F.col("n") - 1).alias("trial_id")
    return rows.join(checked.select("batch", "first"), "batch").select(trial, *COLUMNS[1:])


def count_trials(spark: SparkSession, path: str) -> int:
    return read_trials(spark, path).count()


def _appended(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Append rows numbered by `n`; the id of the first. Cells are checked before anything is claimed."""
    bad = F.when((F.trim("question") == "") | (F.trim("metric") == ""), "an empty question or metric").when(~F.col("status").isin(*STATUSES), "unknown status")
    problems = rows.select(bad.alias("bad")).where("bad IS NOT NULL").take(1)
    if problems:
        raise ValueError(problems[0]["bad"])
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at")
    batch = uuid.uuid4().hex
    rows.select(F.lit(batch).alias("batch"), "n", stamp, *COLUMNS[2:]).write.parquet(f"{path}/batches/{batch}")
    return _claimed(spark, path, batch, rows.count())


def _cells(given: dict[str, Column]) -> list[Column]:
    """All columns of a trial but those that the registry gives; unknown ones are refused."""
    own, unknown = [c for c in ("trial_id", "logged_at") if c in given], sorted(set(given) - set(COLUMNS))
    if own or unknown:
        raise ValueError(f"columns not for the caller: {own + unknown}")
    for needed in ("question", "metric"):
        if needed not in given:
            raise ValueError(f"no column {needed}")
    default = lambda c: F.lit("descriptive" if c == "status" else "")
    return [(F.coalesce(given[c].cast("string"), F.lit("")) if c in given else default(c)).alias(c) for c in COLUMNS[2:]]


def log_trials(spark: SparkSession, path: str, trials: DataFrame) -> DataFrame:
    """Append trials, in the order of the rows, and return them with their ids. Ids and times are the registry's to give.

    Unknown columns are refused before anything is written, and so are rows with an empty question or metric or an unknown status.
    """
    made = trials.select(*_cells({c: F.col(c) for c in trials.columns})).withColumn("given", F.monotonically_increasing_id())
    rows = kept(numbered(made, ["given"], "n").drop("given"), "trials")
    first = _appended(spark, path, rows)
    return read_trials(spark, path).where(F.col("trial_id").between(first, first + rows.count() - 1))


def logged(spark: SparkSession, path: str, rows: DataFrame, trial: dict[str, Column]) -> DataFrame:
    """`rows` with the `trial_id` under which each was logged; `trial` makes a trial's columns of a row's. The rows come as a table that was
    written before the log was, so what is shown is what was logged."""
    name = next(f"{'_' * k}given" for k in range(99) if f"{'_' * k}given" not in rows.columns)
    table = kept(numbered(rows.withColumn(name, F.monotonically_increasing_id()), [name], "n").drop(name), "logged")
    first = _appended(spark, path, table.select("n", *_cells(trial)))
    return table.withColumn("trial_id", F.col("n") + first - 1).drop("n")


def decay_trial(ticker: str, date: str) -> dict[str, Column]:
    """How a row of forecast.decay is logged."""
    split = F.when(F.col("direction") == "forward", "first-half/second-half").otherwise("second-half/first-half")
    said = F.format_string("beta=%s; t=%s; r2_oos=%s; z=%s; n_fit=%s; n_test=%s", *[F.col(c).cast("string") for c in ("beta", "t", "r2", "z", "n_fit", "n_test")])
    return {
        "question": F.concat(F.lit("next bucket's mid change on this bucket's "), F.when(F.col("predictor") == "ofi", "flow").otherwise("mid change")),
        "ticker": F.lit(ticker), "date": F.lit(date), "clock": F.lit("calendar"), "bucket": F.col("h"), "horizon": F.col("h"), "split": split,
        "n_obs": F.col("n_test"), "metric": F.lit("hit_rate"), "value": F.col("hit_rate"), "status": F.lit("predictive"), "note": said,
    }
