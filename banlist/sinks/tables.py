"""Writing selections, results and saved runs as partitioned tables.

What is saved in several tables is committed by the one that is written last: it
names the parts that belong together, and readers join it. Parts of a save that failed
on its way are not seen, and saving again is all that is needed.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.operators.selection import (
    Criteria,
    TokenTables,
    compare_selections,
    parse_criteria,
    select_custom,
    selected_rows,
    summarise,
)
from banlist.session import write_table


def criteria_hash(criteria: str | Criteria) -> str:
    """A short name for a criteria object, the same for any key order."""
    text = json.dumps(parse_criteria(criteria), sort_keys=True, ensure_ascii=False)
    return hashlib.md5(text.encode("utf-8")).hexdigest()[:16]


def _replace(df: DataFrame, *by: str):
    """A writer that replaces the partitions it writes to and no others."""
    # Rebalancing splits a partition value that holds most of the rows and
    # joins the small files of the others.
    writer = df.hint("rebalance", *by).write.partitionBy(*by).mode("overwrite")
    return writer.option("partitionOverwriteMode", "dynamic")


def save_selected_tokens(
    tables: TokenTables, criteria: Mapping[str, str | Criteria], model: str, path: str
) -> None:
    """Write ``path/tokens`` and ``path/summary``, one partition per model and criteria.

    Saving a criterion again replaces what was saved of it: its row of the summary,
    written last, names the save whose tokens count. `clear_replaced` deletes the others.
    """
    by_hash = {criteria_hash(one): one for one in criteria.values()}
    save = {"model": F.lit(model), "save_id": F.lit(uuid.uuid4().hex)}

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("criteria", "criteria_hash").withColumns(save)

    selected = write_table(selected_rows(tables, by_hash), "selected")
    tokens = keyed(selected.where("within").drop("within"))
    by = ["model", "criteria_hash", "save_id"]
    tokens.hint("rebalance", *by).write.partitionBy(*by).mode("append").parquet(f"{path}/tokens")
    _replace(keyed(summarise(tables, by_hash, selected)), "model", "criteria_hash").parquet(f"{path}/summary")


def read_selected_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All selections saved in a folder, with their summaries."""
    tokens, summary = _saved_tokens(spark, path), _saved_summary(spark, path)
    return tokens.join(summary, ["model", "criteria_hash", "save_id"])


def _saved_tokens(spark: SparkSession, path: str) -> DataFrame:
    # A selection of nothing leaves no file to take the columns from.
    columns = "token string, token_id long, model string, criteria_hash string, save_id string"
    return spark.read.schema(columns).parquet(f"{path}/tokens")


def _saved_summary(spark: SparkSession, path: str) -> DataFrame:
    columns = "n_tokens long, summary string, save_id string, model string, criteria_hash string"
    return spark.read.schema(columns).parquet(f"{path}/summary")


def clear_replaced(spark: SparkSession, path: str) -> int:
    """Delete the token files of saves that no summary names; not while others save.
    Returns how many saves went."""
    listed = _saved_summary(spark, path).select("model", "criteria_hash", "save_id")
    files = _saved_tokens(spark, path).select("model", "criteria_hash", "save_id", F.col("_metadata.file_path").alias("file"))
    gone = files.join(listed, listed.columns, "left_anti")
    folders = gone.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()
    for folder in folders:  # one for each save
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder.folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(folders)


def load_saved_tokens(
    tables: TokenTables, criteria: str | Criteria, model: str, path: str, reference_rule: bool = False
) -> tuple[str, DataFrame]:
    """The saved summary and tokens of one criterion; an error if it was never saved.

    Custom lists are selected again and must not have changed.
    """
    spark = tables.vocab.sparkSession
    own = (F.col("model") == model) & (F.col("criteria_hash") == criteria_hash(criteria))
    summary = _saved_summary(spark, path).where(own).select("summary", "save_id").head(1)
    if not summary:
        raise FileNotFoundError(f"no saved selection of this criterion for {model!r} in {path}")
    saved = _saved_tokens(spark, path).where(own & (F.col("save_id") == summary[0]["save_id"]))
    saved = saved.select("token", "token_id")
    parsed = parse_criteria(criteria)
    if parsed.get("type") == "custom":
        check = compare_selections(saved, select_custom(tables, parsed), reference_rule).first()
        if check["differs"]:
            raise ValueError(
                f"saved tokens differ from the selection: {check['only_saved']} only saved, "
                f"{check['only_fresh']} only selected"
            )
    return summary[0]["summary"], saved


def save_results(
    results: DataFrame,
    answers: DataFrame,
    tokens: DataFrame,
    dataset: str,
    model: str,
    criteria_type: str,
    criteria_name: str,
    path: str,
    file_format: str = "parquet",
) -> str:
    """Write ``path/results``, ``path/answers`` and ``path/tokens`` of one run.

    All three carry the run's id, time and criteria name and are partitioned by
    dataset, model and criteria type; runs are added, never replaced. Returns
    the id, by which the three are joined. The run counts once it is listed in
    ``path/runs``, which is written last; `read_results` reads listed runs only.
    """
    run_id = uuid.uuid4().hex
    stamp = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    by = {"dataset": F.lit(dataset), "model": F.lit(model), "criteria_type": F.lit(criteria_type)}
    run = {
        "run_id": F.lit(run_id),
        "run_ts": F.lit(stamp.isoformat(sep=" ")).cast("timestamp"),
        "criteria_name": F.lit(criteria_name),
    }
    for name, df in (("results", results), ("answers", answers), ("tokens", tokens)):
        whole = df.withColumns(run | by).hint("rebalance", *by)
        whole.write.partitionBy(*by).mode("append").format(file_format).save(f"{path}/{name}")
    listed = answers.sparkSession.range(1).select(*(v.alias(k) for k, v in (run | by).items()))
    listed.write.mode("append").parquet(f"{path}/runs")
    return run_id


def read_results(spark: SparkSession, path: str, name: str, file_format: str = "parquet") -> DataFrame:
    """The rows of ``results``, ``answers`` or ``tokens`` of all runs that were saved whole."""
    listed = spark.read.parquet(f"{path}/runs").select("run_id")
    return spark.read.format(file_format).load(f"{path}/{name}").join(listed, "run_id", "left_semi")


def save_runs(
    runs: DataFrame, model: str, criteria: str, k_shot: int, n_samples: int, path: str
) -> None:
    """Write saved runs by model, criteria, shots and sample count, in place of
    the run that was saved under them before."""
    run = {
        "model": F.lit(model),
        "criteria": F.lit(criteria),
        "k_shot": F.lit(k_shot),
        "n_samples": F.lit(n_samples),
    }
    _replace(runs.withColumns(run), *run).parquet(path)
