"""Sinks (SNK): result stores with append, upsert and merge, text tables.

The store is a directory of Parquet runs (run=N). Rows are keyed in full, so an upsert never drops a neighbour's rows.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.filters import first_of
from marquee.sources.readers import exists


class RunStore:
    """SNK2, SNK3: numbered runs below one path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def runs(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[4:]) for n in names if n.startswith("run="))

    def append(self, df: DataFrame) -> int:
        """A new run numbered one above the highest."""
        number = max(self.runs(), default=0) + 1
        df.write.mode("errorifexists").parquet(f"{self.path}/run={number}")
        return number

    def upsert(self, df: DataFrame) -> int:
        """A new run: the last one with the incoming rows in place of those of equal keys."""
        runs = self.runs()
        if not runs:
            return self.append(df)
        return self.append(upserted(self.spark.read.parquet(f"{self.path}/run={runs[-1]}"), df, self.keys))

    def read(self) -> DataFrame:
        """All runs, with their number in column run."""
        return self.spark.read.parquet(self.path)

    def merged(self) -> DataFrame:
        """SNK3: the last written row of every key over all runs."""
        return last_written(self.read(), self.keys, "run").drop("run")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those whose keys come anew, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_written(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key, the one written last; a bias of 0, 0.0 and '0' is one key."""
    normal = df.withColumn("bias", F.col("bias").cast("double")) if "bias" in df.columns else df
    return first_of(normal, keys, [F.desc(at)])


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1: CSV with a header; written by all tasks."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    """SNK11: JSON lines."""
    df.write.mode("overwrite").json(path)


class ProfileLog:
    """SNK8: a session's profile log: stages with their durations and whatever else is said of them, as JSON lines.

    Events are few (stages, not rows) and are gathered on the driver; write() puts them below the given folder, one file a
    session. A log that is not enabled takes no notice of anything.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, enabled: bool = True, **facts):
        self.spark, self.path, self.enabled, self.rows = spark, f"{folder}/{name}", enabled, []
        self.event("session.start", **facts)

    def event(self, stage: str, duration: float | None = None, **facts) -> None:
        if self.enabled:
            at = datetime.datetime.now(datetime.timezone.utc).isoformat()
            self.rows.append((at, stage, None if duration is None else round(float(duration), 6), json.dumps(facts, sort_keys=True, default=str) if facts else None))

    @contextmanager
    def timed(self, stage: str, **facts):
        start = time.perf_counter()
        try:
            yield self
        finally:
            self.event(stage, time.perf_counter() - start, **facts)

    def write(self) -> str:
        if self.enabled:
            self.spark.createDataFrame(self.rows, "ts string, stage string, duration_s double, extra string").coalesce(1).write.mode("append").json(self.path)
            self.rows = []
        return self.path


def without(df: DataFrame, *columns: str) -> DataFrame:
    """SNK10: heavy columns left out before storing."""
    return df.drop(*columns)


#: Characters LaTeX reads as commands, and how to write them.
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def escape_latex(text: str) -> str:
    """STR9."""
    return "".join(LATEX.get(c, c) for c in text)


def best_of(df: DataFrame, columns: list[str], least: bool = True) -> Callable[[dict, str], bool]:
    """SNK6: which cells of a report table are the best of their column, as latex_table's bold; computed once."""
    best = df.agg(*[(F.min if least else F.max)(c).alias(c) for c in columns]).first().asDict()
    return lambda row, c: c in best and row[c] == best[c]


def latex_table(df: DataFrame, caption: str = "", bold: Callable[[dict, str], bool] | None = None, missing: str = "--", digits: int = 2, heads: list[tuple[str, int]] | None = None, most: int = 500) -> str:
    """SNK6: a report table as LaTeX; heads adds a row of spanning heads. Reports are small: more than `most` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(row: dict, c: str) -> str:
        v = row[c]
        text = missing if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else escape_latex(str(v))
        return rf"\textbf{{{text}}}" if bold and v is not None and bold(row, c) else text

    lines = [rf"\begin{{tabular}}{{{'l' + 'r' * (len(df.columns) - 1)}}}", r"\toprule"]
    if heads:
        lines.append(" & ".join(rf"\multicolumn{{{n}}}{{c}}{{{escape_latex(t)}}}" for t, n in heads) + r" \\")
    lines += [" & ".join(map(escape_latex, df.columns)) + r" \\", r"\midrule"]
    lines += [" & ".join(cell(r.asDict(), c) for c in df.columns) + r" \\" for r in rows]
    body = "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])
    return "\n".join([r"\begin{table}", r"\centering", body, *([rf"\caption{{{escape_latex(caption)}}}"] if caption else []), r"\end{table}"])


def stored(spark: SparkSession, path: str) -> bool:
    return exists(spark, path)
