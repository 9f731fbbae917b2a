"""The lake: {root}/{release}/theme=T/type=U/*.parquet on any file system that Spark reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quadrille.errors import ReleaseVersionNotSupportedError

#: Fixed value: the first supported release.
FIRST_RELEASE = "2024-04-16-beta.0"
#: Options for anonymous reads of a public bucket through s3a.
ANONYMOUS_S3 = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider", "fs.s3a.endpoint.region": "us-west-2", "fs.s3a.connection.timeout": "30s", "fs.s3a.connection.establish.timeout": "10s"}


def settings_for(path: str) -> dict[str, str]:
    """What reads below this path need: buckets are read without credentials."""
    return ANONYMOUS_S3 if path.startswith("s3a:") else {}


def checked_release(release: str) -> str:
    """Releases compare as text."""
    if release < FIRST_RELEASE:
        raise ReleaseVersionNotSupportedError(f"Release {release} is older than {FIRST_RELEASE}, the first supported one")
    return release


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what lies in a folder; nothing if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
    for name, value in settings_for(path).items():
        conf.setIfUnset(name, value)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(where))


@dataclass(frozen=True)
class Lake:
    """A root folder (file:, s3a:, hdfs: ...) with a folder for each release."""

    spark: SparkSession
    root: str

    def releases(self) -> list[str]:
        """All supported releases, newest first."""
        return sorted((n for n, folder, _ in listed(self.spark, self.root) if folder and n >= FIRST_RELEASE), reverse=True)

    def newest(self) -> str:
        found = self.releases()
        if not found:
            raise ValueError(f"no release in {self.root}")
        return found[0]

    def resolved(self, release: str | None) -> str:
        return self.newest() if release is None else checked_release(release)

    def pairs(self, release: str | None = None) -> list[tuple[str, str]]:
        """The themes and types of a release, sorted."""
        base = f"{self.root}/{self.resolved(release)}"
        themes = [n for n, folder, _ in listed(self.spark, base) if folder and n.startswith("theme=")]
        return sorted((t[6:], u[5:]) for t in themes for u, folder, _ in listed(self.spark, f"{base}/{t}") if folder and u.startswith("type="))

    def folder(self, theme: str, type_: str, release: str | None = None) -> str:
        return f"{self.root}/{self.resolved(release)}/theme={theme}/type={type_}"

    def files(self, theme: str, type_: str, release: str | None = None) -> list[str]:
        base = self.folder(theme, type_, release)
        return [f"{base}/{n}" for n, folder, _ in listed(self.spark, base) if not folder and n.endswith(".parquet")]

    def read(self, theme: str, type_: str, release: str | None = None, files: list[str] | None = None, merge_schema: bool = False) -> DataFrame:
        """A table without its partition columns; `files` narrows it to some of its files, merge_schema joins files of different columns."""
        return self.spark.read.options(**settings_for(self.root)).option("mergeSchema", merge_schema).parquet(*(files or [self.folder(theme, type_, release)]))
