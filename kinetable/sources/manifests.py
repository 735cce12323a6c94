"""Split manifests, append-only result files and captions: nested JSON as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "file string, num_frames int, fps int, caption string, clips_by_object map<string,array<array<int>>>, num_clips_total int"
PREDICTION = "example_id string, dataset string, video string, obj string, t0 int, batch_idx int, l2 double, mae double, n_visible int, gt_future_raw array<array<array<double>>>, pred_raw_combined array<array<array<double>>>, gt_future_vis array<array<boolean>>"


def read_manifest(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "test"), dataset: str = "") -> DataFrame:
    """Entries of the wanted splits, with split and dataset as columns."""
    schema = ", ".join(f"{s} array<struct<{_struct()}>>" for s in ("train", "test"))
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    out = None
    for s in splits:
        part = raw.select(F.inline(s)).withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("dataset", F.lit(dataset))


def _struct() -> str:
    return ENTRY.replace(" string", ":string").replace(" int", ":int").replace(" map<", ":map<")


def clips(entries: DataFrame) -> DataFrame:
    """One row for each clip range of each object."""
    rows = entries.select("dataset", "split", "file", "num_frames", F.explode("clips_by_object").alias("obj", "_r"))
    rows = rows.select("dataset", "split", "file", "num_frames", "obj", F.posexplode("_r").alias("clip_idx", "_c"))
    return rows.select("dataset", "split", "file", "num_frames", "obj", "clip_idx", F.get("_c", F.lit(0)).alias("begin"), F.get("_c", F.lit(1)).alias("end"))


def keep_listed_objects(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries with only those objects that ``keys`` (file, keys) lists; a file listed with the
    single key ``__flat__`` keeps all, a file not listed goes, and so does one left empty."""
    e = entries.join(keys.select("file", "keys"), "file")
    kept = F.when(F.array_contains("keys", "__flat__"), F.col("clips_by_object")).otherwise(F.map_filter("clips_by_object", lambda k, v: F.array_contains("keys", k)))
    e = e.withColumn("clips_by_object", kept).where(F.size("clips_by_object") > 0).drop("keys")
    return e.withColumn("num_clips_total", F.aggregate(F.map_values("clips_by_object"), F.lit(0), lambda n, c: n + F.size(c)))


def rescale_frames(entries: DataFrame, stride: int) -> DataFrame:
    """Entries of a track that keeps every stride-th frame."""
    scale = lambda c: F.array(F.floor(F.get(c, F.lit(0)) / stride).cast("int"), F.floor(F.get(c, F.lit(1)) / stride).cast("int"))
    moved = F.transform_values("clips_by_object", lambda k, v: F.filter(F.transform(v, scale), lambda c: F.get(c, F.lit(1)) >= F.get(c, F.lit(0))))
    return entries.withColumn("num_frames", F.ceil(F.col("num_frames") / stride).cast("int")).withColumn("clips_by_object", moved)


def read_results(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """Results written line by line; a line cut short by a crash is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def explode_predictions(results: DataFrame) -> DataFrame:
    """Long rows (point, frame, x, y, z of truth and forecast, visible) of (P, F, 3) arrays."""
    p = results.select("example_id", "dataset", "video", "obj", "t0", F.posexplode(F.arrays_zip("gt_future_raw", "pred_raw_combined", "gt_future_vis")).alias("point", "_p"))
    f = p.select("example_id", "dataset", "video", "obj", "t0", "point", F.posexplode(F.arrays_zip("_p.gt_future_raw", "_p.pred_raw_combined", "_p.gt_future_vis")).alias("frame", "_f"))
    g, h = F.col("_f.gt_future_raw"), F.col("_f.pred_raw_combined")
    square = [(F.get(g, F.lit(i)) - F.get(h, F.lit(i))) * (F.get(g, F.lit(i)) - F.get(h, F.lit(i))) for i in range(3)]
    ok = F.col("_f.gt_future_vis") & ~F.isnan(square[0] + square[1] + square[2])
    return f.select("example_id", "dataset", "video", "obj", "t0", "point", "frame", F.when(ok, F.sqrt(square[0] + square[1] + square[2])).alias("err"))


def valid_length_index(rows: DataFrame) -> DataFrame:
    """One JSON text {house: {file: {trajectory: length}}} for each house (house, file, traj, length);
    keys in order of their text."""
    text = lambda c: F.col(c).cast("string")
    files = rows.groupBy("house", "file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(text("traj").alias("traj"), F.col("length"))))).alias("m"))
    houses = files.groupBy("house").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(text("file").alias("file"), F.to_json("m").alias("m"))), lambda a, b: F.when(a["file"] < b["file"], -1).otherwise(1))).alias("m"))
    # the inner maps are JSON already: they are put in by their text
    inner = F.transform(F.map_entries("m"), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return houses.select("house", F.concat(F.lit("{"), F.to_json(F.array(text("house"))).substr(F.lit(2), F.length(F.to_json(F.array(text("house")))) - 2), F.lit(":{"), F.array_join(inner, ","), F.lit("}}")).alias("index"))


def write_manifest(entries: DataFrame, folder: str) -> str:
    """Entries (dataset, split, file, ...) as one manifest a dataset: {"train": [...], "test": [...]}."""
    fields = [c for c in entries.columns if c not in ("dataset", "split")]
    part = lambda s: F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct(*fields))), lambda a, b: F.when(a["file"] < b["file"], -1).otherwise(1)).alias(s)
    m = entries.groupBy("dataset").agg(part("train"), part("test"))
    m.write.mode("append").partitionBy("dataset").json(folder)
    return folder


def read_manifests(spark: SparkSession, folder: str, train: bool, schema: str) -> DataFrame:
    """Entries of all datasets' manifests: those of the test split to evaluate, of both to train."""
    kinds = ", ".join(f"{s} array<struct<{schema}>>" for s in ("train", "test"))
    raw = spark.read.schema(f"{kinds}, dataset string").json(folder)
    out = raw.select("dataset", F.inline("test")).withColumn("split", F.lit("test"))
    return raw.select("dataset", F.inline("train")).withColumn("split", F.lit("train")).unionByName(out) if train else out


def flat_messages(rows: DataFrame, messages: str) -> DataFrame:
    """A row for each nested message, with the columns ``metadata/...`` gathered in one struct."""
    meta = [c for c in rows.columns if c.startswith("metadata/")]
    inside = F.struct(*[F.col(f"`{c}`").alias(c.removeprefix("metadata/")) for c in meta]).alias("metadata")
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (*meta, messages)]
    return rows.select(*rest, inside, F.inline(F.flatten(messages)))


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """(task, action): the action has had two names."""
    raw = spark.read.schema("task long, action string, language_instruction string").json(path)
    return raw.select("task", F.coalesce("action", "language_instruction").alias("action"))


def hub_scan(spark: SparkSession, path: str, in_memory: bool = False) -> DataFrame:
    """A columnar dataset; kept in executors' memory if asked for."""
    df = spark.read.parquet(path)
    return df.cache() if in_memory else df
