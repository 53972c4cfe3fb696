"""Readers, writers and catalogues of series, segments, parameters and results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_si
from ..operators.segments import clip_segments
from ..operators.series import compress_time_segments, dedupe_times, expand_time_segments

SERIES = "source string, detector string, freqfactor double, t double, re double, im double, sigma double"
META = "source string, detector string, freqfactor double, attrs map<string,string>"


def _numbers(spark: SparkSession, paths, width: int) -> DataFrame:
    """Lines of a text (gz too) without comments, as numbers c0.. and the file they came from."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.where(~F.col("value").rlike(r"^\s*[#%]") & (F.trim("value") != ""))
    return rows.select("path", *[F.get(parts, F.lit(i)).try_cast("double").alias(f"c{i}") for i in range(width)])


def read_series_text(spark: SparkSession, paths) -> DataFrame:
    """(path, t, re, im, sigma) of three- or four-column text; sigma is null without a fourth column."""
    return _numbers(spark, paths, 4).toDF("path", "t", "re", "im", "sigma")


def read_comments(spark: SparkSession, paths) -> DataFrame:
    """(path, comment): comment lines as metadata."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.where(F.col("value").rlike(r"^\s*[#%]")).select("path", F.regexp_replace("value", r"^\s*[#%]+\s*", "").alias("comment"))


def write_series_text(df: DataFrame, path: str, key: list[str], comments: list[str] = ()) -> None:
    """t re im [sigma] lines in folders by key, each below a header of comment lines; sigma only if the table has it."""
    cols = ["t", "re", "im", *(["sigma"] if "sigma" in df.columns else [])]
    order = [F.lit(len(comments)).alias("_h"), F.col("t").alias("_t")]
    lines = df.select(*key, *order, F.concat_ws(" ", *cols).alias("line"))
    if comments:
        head = F.posexplode(F.array(*[F.lit(f"# {c}") for c in comments])).alias("_h", "line")
        heads = df.select(*key).distinct().select(*key, head)
        lines = lines.unionByName(heads.withColumn("_t", F.lit(None).cast(df.schema["t"].dataType)))
    lines.repartition(*key).sortWithinPartitions(*key, "_h", "_t").select(*key, "line").write.partitionBy(*key).text(path)


def read_series(spark: SparkSession, path: str, meta: str | None = None) -> DataFrame:
    """Stored series; with ``meta`` the side table (a row for each series) is joined."""
    df = spark.read.schema(SERIES).parquet(path)
    return df.join(spark.read.schema(META).parquet(meta), ["source", "detector", "freqfactor"], "left") if meta else df


def write_series(df: DataFrame, path: str) -> None:
    df.repartition("detector", "freqfactor", "source").sortWithinPartitions("source", "t").write.partitionBy("detector", "freqfactor").parquet(path)


STORED = ["source", "detector", "freqfactor"]


def write_series_compact(df: DataFrame, path: str, dt) -> None:
    """Values and times apart: ``path``/values has each sample's place and value, ``path``/times the (start, end) of the runs by dt."""
    place = F.row_number().over(Window.partitionBy(*STORED).orderBy("t")) - 1
    cols = ["re", "im", *(["sigma"] if "sigma" in df.columns else [])]
    df.select(*STORED, place.cast("long").alias("i"), *cols).write.parquet(f"{path}/values")
    compress_time_segments(df, dt, STORED).select(*STORED, F.col("start").cast("double"), F.col("end").cast("double")).write.parquet(f"{path}/times")


def read_series_compact(spark: SparkSession, path: str, dt) -> DataFrame:
    """What write_series_compact wrote, each sample with its time again."""
    times = expand_time_segments(spark.read.parquet(f"{path}/times"), dt, STORED)
    return times.join(spark.read.parquet(f"{path}/values"), [*STORED, "i"]).drop("i")


def read_and_merge(spark: SparkSession, paths: list[str], key: list[str] | None = None) -> DataFrame:
    """Many text files of one series: missing and empty ones are skipped, repeated times keep the first file's.

    Files are told apart by their whole paths. The folders are listed once, by Spark.
    """
    bare = r"^[A-Za-z0-9+.-]+:(//[^/]*)?(?=/)"
    order = spark.createDataFrame([(re.sub(bare, "", p), i) for i, p in enumerate(dict.fromkeys(paths))], "file string, pos int")
    folders = sorted({p.rpartition("/")[0] or "." for p in paths})
    names = sorted({p.rpartition("/")[2] for p in paths})
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(folders)
    found = listed.where("length > 0").select("path", F.regexp_replace("path", bare, "").alias("file")).join(F.broadcast(order), "file")
    there = [r["path"] for r in found.collect()]  # no more than the paths that were given
    none = spark.createDataFrame([], "t double, re double, im double")
    if not there:
        return none
    lines = spark.read.text(there).select("value", F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), bare, "").alias("file"))
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.where(~F.col("value").rlike(r"^\s*[#%]")).join(F.broadcast(order), "file").select(
        "pos", *[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(none.columns)], F.lit(1).alias("k")
    )
    return dedupe_times(rows.where("t is not null"), "pos", ["k"]).drop("pos", "k")


_FRAME = r"([A-Z]+)-([A-Za-z0-9_]+)-(\d+)-(\d+)\.[A-Za-z0-9]+$"


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, site, frtype, gps_start, duration) of SITE-TYPE-GPS-DUR files below a folder; other names are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return parse_catalog(files)


def parse_catalog(files: DataFrame) -> DataFrame:
    g = lambda i: F.regexp_extract("path", _FRAME, i)
    rows = files.where(F.col("path").rlike(_FRAME))
    return rows.select("path", g(1).alias("site"), g(2).alias("frtype"), g(3).cast("long").alias("gps_start"), g(4).cast("long").alias("duration"))


def select_files(catalog: DataFrame, site: str, frtype: str, t0: float, t1: float) -> DataFrame:
    """Files that overlap [t0, t1], sites compared by first letter, in order of start."""
    same = (F.substring("site", 1, 1) == site[0]) & (F.col("frtype") == frtype)
    return catalog.where(same & (F.col("gps_start") + F.col("duration") > t0) & (F.col("gps_start") < t1)).orderBy("gps_start", "path")


def read_segments(spark: SparkSession, paths, t0: float, t1: float) -> DataFrame:
    """(start, end) of two-column text, clipped to [t0, t1]."""
    return clip_segments(_numbers(spark, paths, 2).toDF("path", "start", "end").where("start is not null and end is not null"), t0, t1)


def parameter_lines(texts: DataFrame) -> DataFrame:
    """(source, key, idx, value, svalue, err, fit) in SI from (path, value): a parameter file's text in a row.

    A line: key value [fit flag 0/1] [error]; a value's number is null where it is a word. The source is PSRJ, else PSRB, PSR, NAME.
    """
    lines = texts.select("path", F.posexplode(F.split("value", "\n")).alias("idx", "line"))
    p = F.split(F.trim("line"), r"\s+")
    item = lambda i: F.get(p, F.lit(i))
    rows = lines.where((F.size(p) >= 2) & ~F.col("line").rlike(r"^\s*#")).select(
        "path", F.upper(item(0)).alias("key"), "idx", item(1).alias("svalue"),
        F.when(F.size(p) >= 4, item(2) == "1").otherwise(False).alias("fit"), F.coalesce(item(3), F.when(F.size(p) == 3, item(2))).try_cast("double").alias("err"),
    )
    names = rows.where(F.col("key").isin("PSRJ", "PSRB", "PSR", "NAME")).groupBy("path").agg(
        F.min_by("svalue", F.array_position(F.array(*[F.lit(x) for x in ("PSRJ", "PSRB", "PSR", "NAME")]), F.col("key"))).alias("source")
    )
    return rows.join(names, "path", "left").select("source", "key", "idx", to_si("key", "svalue").alias("value"), "svalue", "err", "fit")


def read_parameters(spark: SparkSession, paths) -> DataFrame:
    texts = spark.read.option("wholetext", "true").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return parameter_lines(texts)


def sources_of(parameters: DataFrame, keys: list[str]) -> DataFrame:
    """The wide form: a row for each source."""
    return parameters.groupBy("source").pivot("key", keys).agg(F.first("value"))


def results_catalog(files: DataFrame, prefix: str) -> DataFrame:
    """(path, source, dets) of {prefix}_{dets}_{source}_result.{json,hdf5} names."""
    m = rf"{prefix}_([A-Z0-9]+)_(.+)_result\.(json|hdf5)$"
    return files.where(F.col("path").rlike(m)).select("path", F.regexp_extract("path", m, 2).alias("source"), F.regexp_extract("path", m, 1).alias("dets"))


def select_results(catalogue: DataFrame, source: str | None = None, dets: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Results of a source, a detector set or both; what isn't there is a KeyError.

    ``wanted`` (source, dets) lists results that have to be there: an anti-join finds those that are absent.
    """
    out = catalogue.where(F.col("source") == source) if source is not None else catalogue
    out = out.where(F.col("dets") == dets) if dets is not None else out
    if (source is not None or dets is not None) and out.isEmpty():
        raise KeyError(f"no results of {source or 'any source'} for {dets or 'any detectors'}")
    if wanted is None:
        return out
    absent = wanted.select("source", "dets").join(out, ["source", "dets"], "left_anti")
    first = [f"{r['source']} {r['dets']}" for r in absent.limit(5).collect()]
    if first:
        raise KeyError(f"results are missing, among them: {', '.join(first)}")
    return out.join(wanted.select("source", "dets").distinct(), ["source", "dets"], "left_semi").select(*out.columns)


#: What is read of a result file; other fields are left alone.
RESULT = "label string, log_evidence double, log_noise_evidence double, log_bayes_factor double, posterior struct<content:map<string,array<double>>>"


def read_results_json(spark: SparkSession, paths, parameters: list[str], lines: bool = False) -> DataFrame:
    """A row for each draw of JSON results: path, label, ln_z, ln_z_noise, draw and a column for each parameter.

    A file is one result (or, with ``lines``, has one in each line). A parameter that a result
    doesn't have is null; one with fewer draws than another ends in nulls; a file that is no JSON is an error.
    """
    read = spark.read.schema(RESULT).option("multiLine", not lines).option("mode", "FAILFAST")
    rows = read.json(paths).select(F.col("_metadata.file_path").alias("path"), "label", F.col("log_evidence").alias("ln_z"), F.col("log_noise_evidence").alias("ln_z_noise"), *[F.col("posterior.content")[p].alias(f"_{p}") for p in parameters])
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(*[F.coalesce(f"_{p}", none).alias(p) for p in parameters])
    draws = rows.select("path", "label", "ln_z", "ln_z_noise", F.posexplode(zipped).alias("draw", "_z"))
    return draws.select("path", "label", "ln_z", "ln_z_noise", "draw", *[F.col(f"_z.{p}").alias(p) for p in parameters])


def series_catalog(files: DataFrame) -> DataFrame:
    """(path, source, detector, freqfactor) of heterodyne_{source}_{det}_{freqfactor}_... names; others are skipped."""
    m = r"heterodyne_([^_/]+)_([A-Z]\d)_(\d+(?:\.\d+)?)_[^/]*$"
    return files.where(F.col("path").rlike(m)).select(
        "path", F.regexp_extract("path", m, 1).alias("source"), F.regexp_extract("path", m, 2).alias("detector"), F.regexp_extract("path", m, 3).cast("double").alias("freqfactor")
    )


#: Public observing runs: detector, run, first and last GPS second (fixed values).
RUNS = [
    ("H1", "S5", 815155213, 875232014), ("H2", "S5", 815155213, 875232014), ("L1", "S5", 815155213, 875232014),
    ("H1", "S6", 931035615, 971622015), ("L1", "S6", 931035615, 971622015),
    ("H1", "O1", 1126051217, 1137254417), ("L1", "O1", 1126051217, 1137254417),
    ("H1", "O2", 1164556817, 1187733618), ("L1", "O2", 1164556817, 1187733618), ("V1", "O2", 1185624018, 1187733618),
    ("H1", "O3", 1238166018, 1269363618), ("L1", "O3", 1238166018, 1269363618), ("V1", "O3", 1238166018, 1269363618),
    ("H1", "O3a", 1238166018, 1253977218), ("L1", "O3a", 1238166018, 1253977218), ("V1", "O3a", 1238166018, 1253977218),
    ("H1", "O3b", 1256655618, 1269363618), ("L1", "O3b", 1256655618, 1269363618), ("V1", "O3b", 1256655618, 1269363618),
    ("H1", "O4a", 1368975618, 1389456018), ("L1", "O4a", 1368975618, 1389456018),
]
#: Where continuous-wave hardware injections began later than the run (fixed values); V1 and H1, L1 of the other runs: none, and the whole run.
INJECTIONS_FROM = {("H1", "S5"): 829412600, ("H2", "S5"): 829412616, ("L1", "S5"): 829413522}


def injection_runs(spark: SparkSession, run: str | None = None, detector: str | None = None) -> DataFrame:
    """Spans with continuous-wave hardware injections, with the segment flags to include and exclude."""
    rows = [(d, r, INJECTIONS_FROM.get((d, r), a), b) for d, r, a, b in RUNS if d != "V1"]
    df = spark.createDataFrame(rows, "detector string, run string, start long, end long")
    old = F.col("run").isin("S5", "S6")
    flags = df.withColumns({"include": F.concat("detector", F.when(old, "_CW_CAT1").otherwise("_CBC_CAT1")), "exclude": F.when(~old, F.concat("detector", F.lit("_NO_CW_HW_INJ")))})
    flags = flags.where(F.col("run") == run) if run else flags
    return flags.where(F.col("detector") == detector) if detector else flags


def runs(spark: SparkSession, run: str | None = None, detector: str | None = None) -> DataFrame:
    """The observing runs, by run or detector if given."""
    df = spark.createDataFrame(RUNS, "detector string, run string, start long, end long")
    df = df.where(F.col("run") == run) if run else df
    return df.where(F.col("detector") == detector) if detector else df


