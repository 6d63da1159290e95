"""Where the build's tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbside.operators.release import content_hash
from curbside.runtime import cut


def stage_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def release_rows(samples: DataFrame, crops: DataFrame) -> DataFrame:
    """file_name, text and split of the samples whose crop exists; files are named by sample."""
    kept = samples.join(crops.select("crop_path"), "crop_path", "left_semi")
    return kept.select(F.concat(F.lit("images/"), F.col("sample_id"), F.lit(".jpg")).alias("file_name"), F.col("caption").alias("text"), "split")


def release_metadata(samples: DataFrame, crops: DataFrame, path: str) -> None:
    """JSON lines of file name and caption by split, for samples whose crop exists."""
    release_rows(samples, crops).write.mode("overwrite").partitionBy("split").json(path)


def release_images(crops: DataFrame, path: str) -> None:
    """Raw crops by split."""
    crops.select("file_name", "width", "height", "data", "split").write.mode("overwrite").partitionBy("split").parquet(path)


class Versions:
    """Whole sets of tables below a folder, of which a reader sees the last committed one, never half of one.

    The tables of a version go to a folder of its own. When all are written, one
    small file that names the folder is moved into place; its number is the
    version's. Of two writers of the same number the second one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[str]:
        at = self._path(f"{self.folder}/committed")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if not f.getPath().getName().startswith(".")) if self._fs.exists(at) else []

    def current(self) -> str | None:
        """The folder of the last committed version."""
        names = self._committed()
        return f"{self.folder}/{self.spark.read.text(f'{self.folder}/committed/{names[-1]}').first().value}" if names else None

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
        """Writes the tables as a new version and commits it; returns its folder."""
        number = int(self._committed()[-1]) + 1 if self._committed() else 1
        own = f"version-{number:08d}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            writer = df.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            writer.parquet(f"{self.folder}/{own}/{name}")
        self._fs.mkdirs(self._path(f"{self.folder}/committed"))
        draft = self._path(f"{self.folder}/committed/.{own}")
        out = self._fs.create(draft, False)
        out.write(bytearray(own.encode()))
        out.close()
        final = self._path(f"{self.folder}/committed/{number:08d}")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {number} of {self.folder} was committed by another writer")
        return f"{self.folder}/{own}"

    def read(self, table: str) -> DataFrame:
        """A table of the last committed version."""
        current = self.current()
        if current is None:
            raise FileNotFoundError(f"{self.folder} has no committed version")
        return self.spark.read.parquet(f"{current}/{table}")


def publish_release(spark: SparkSession, folder: str, built: dict[str, DataFrame], record: DataFrame, crops: DataFrame | None = None) -> str:
    """Commits the tables of a release build, its record with the status of its validation, and its crops as one version.

    The checks are made once; the report and the record read the row they left.
    """
    status = cut(built["status"], "status")
    tables = {"samples": built["samples"], "groups": built["groups"], "evaluation": built["evaluation"], "validation_report": status, "release": validated(record, status)}
    if crops is not None:
        tables["images"] = crops
    return Versions(spark, folder).publish(tables, {"samples": "split"} | ({"images": "split"} if crops is not None else {}))


def release_record(samples: DataFrame, name: str, trigger: str, template_version: str) -> DataFrame:
    """One row: name, status, trigger, template version, content hash and counts."""
    counts = samples.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    own = content_hash(samples).crossJoin(counts)  # single rows
    return own.select(F.lit(name).alias("name"), F.lit("draft").alias("status"), F.lit(trigger).alias("trigger_token"), F.lit(template_version).alias("template_version"), "manifest_hash", "n_train", "n_val")


def eval_cases(cases: DataFrame, path: str, manifest_path: str) -> None:
    cases.write.mode("overwrite").partitionBy("eval_set").json(path)
    cases.select("image_id", "group_id", "eval_set").write.mode("overwrite").parquet(manifest_path)


def fixed_csv(rows: DataFrame, columns: list[str], path: str, order: str | None = None) -> None:
    """CSV with a fixed list of columns, in the order of one; those that are missing are empty."""
    rows = rows if order is None else rows.orderBy(order)
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def one_row(row: DataFrame, path: str) -> None:
    """A one-row result as JSON and as CSV."""
    row.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    row.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)


def validated(record: DataFrame, status: DataFrame) -> DataFrame:
    """The release record with the status that validation gave it."""
    return record.drop("status").crossJoin(status.select("status", "errors"))  # single rows


def write_validation(record: DataFrame, status: DataFrame, path: str) -> DataFrame:
    """Writes the report and the record with its new status; returns the record as it was written."""
    status.coalesce(1).write.mode("overwrite").json(f"{path}/validation_report")
    validated(record, status).coalesce(1).write.mode("overwrite").json(f"{path}/release")
    return record.sparkSession.read.json(f"{path}/release")


def require_validated(record: DataFrame) -> DataFrame:
    """The release record; any status but ``validated`` is an error."""
    found = [r.status for r in record.select("status").limit(2).collect()]
    if found != ["validated"]:
        raise ValueError(f"the release's status is {found}, not validated")
    return record


def provenance(record: DataFrame, release_path: str, commit: str | None = None) -> DataFrame:
    """What a training run notes about its dataset: place, name, status, hash, commit and counts."""
    return record.select(F.lit(release_path).alias("dataset_release"), F.col("name").alias("release_name"), F.col("status").alias("dataset_status"), "manifest_hash", F.lit(commit).cast("string").alias("git_commit"), F.col("n_train").alias("train_count"), F.col("n_val").alias("val_count"))


def generated_path(root: Column, split: Column, bucket: Column, variant: Column, stem: Column, index: Column, folder: str = "images") -> Column:
    """Where the result of a job goes; slashes of a variant's name are replaced."""
    return F.format_string(f"%s/%s/%s/{folder}/%s_aug_%04d_%s.png", root, split, bucket, stem, index, F.replace(variant, F.lit("/"), F.lit("_")))


def comparison_path(root: Column, split: Column, bucket: Column, variant: Column, stem: Column, index: Column) -> Column:
    """Where the picture of a result beside its source goes."""
    return F.format_string("%s/comparison_pairs/%s/%s/%s_pair_%04d_%s.png", root, split, bucket, stem, index, F.replace(variant, F.lit("/"), F.lit("_")))
