"""A cache of downloaded packages: dated files in any file system that Spark reaches, of which the newest counts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = re.compile(r"(.+)-(\d{4}-\d{2}-\d{2})\.zip")


class PackageCache:
    """Files <package>-<date>.zip below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._to = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._to(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def dates(self) -> dict[str, list[str]]:
        """Dates of each package, oldest first."""
        out: dict[str, list[str]] = {}
        if self._fs.exists(self._to(self.path)):
            for x in self._fs.listStatus(self._to(self.path)):
                if m := _NAMED.fullmatch(x.getPath().getName()):
                    out.setdefault(m[1], []).append(m[2])
        return {k: sorted(v) for k, v in out.items()}

    def newest(self, packages: list[str]) -> DataFrame:
        """package, date and content of the newest file of each; an error if one has none."""
        have = self.dates()
        missing = [p for p in packages if p not in have]
        if missing:
            raise OSError(f"packages not in the cache: {missing}")
        wanted = {f"{self.path}/{p}-{have[p][-1]}.zip": (p, have[p][-1]) for p in packages}
        rows = self.spark.read.format("binaryFile").load(list(wanted))
        name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
        return rows.select(F.regexp_extract(name, r"^(.+)-\d{4}-\d{2}-\d{2}$", 1).alias("package"), F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})$", 1).alias("date"), "content")

    def put(self, date: str, contents: dict[str, bytes]) -> None:
        """Writes all packages of a date or none: each beside its place first, then renamed; what was renamed goes again if a later one fails."""
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
            raise ValueError(f"no date: {date!r}")
        self._fs.mkdirs(self._to(self.path))
        mark, temps, done = uuid.uuid4().hex, {}, []
        try:
            for package, content in contents.items():
                temps[package] = self._to(f"{self.path}/.{package}-{mark}")
                out = self._fs.create(temps[package], True)
                try:
                    out.write(bytearray(content))
                    out.hsync()
                finally:
                    out.close()
            for package, temp in temps.items():
                final = self._to(f"{self.path}/{package}-{date}.zip")
                if self._fs.exists(final):
                    self._fs.delete(final, False)
                if not self._fs.rename(temp, final):
                    raise OSError(f"could not move the package {package}")
                done.append(final)
        except Exception:
            for x in [*temps.values(), *done]:
                self._fs.delete(x, False)
            raise
