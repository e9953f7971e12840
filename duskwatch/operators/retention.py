"""Ageing of the log table through storage tiers."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.times import at


TIERS = ["hot", "warm", "cold"]


def _cut(now: str, days: float):
    return at(dt.datetime.fromisoformat(str(now)) - dt.timedelta(days=days))


def retention_tiers(
    logs: DataFrame, *, now: str, hot_days: float = 7, warm_days: float = 30, cold_days: float = 365
) -> DataFrame:
    """Each row with its tier after one retention cycle and what happened to it.

    The moves follow each other, so an old row can go from hot to cold in one
    cycle; rows never come back. ``purged`` rows are to be dropped.
    """
    t = F.col("timestamp")
    rows = logs if "tier" in logs.columns else logs.withColumn("tier", F.lit("hot"))
    to_warm = (F.col("tier") == "hot") & (t < _cut(now, hot_days))
    rows = rows.withColumn("moved_warm", to_warm)
    warm_now = F.col("moved_warm") | (F.col("tier") == "warm")
    rows = rows.withColumn("moved_cold", warm_now & (t < _cut(now, warm_days)))
    cold_now = F.col("moved_cold") | (F.col("tier") == "cold")
    rows = rows.withColumn("purged", cold_now & (t < _cut(now, cold_days)))
    return rows.withColumn("tier", F.when(cold_now, "cold").when(warm_now, "warm").otherwise(F.col("tier")))


def retention_report(tiers: DataFrame) -> DataFrame:
    """How many rows one cycle moved and purged."""
    return tiers.agg(*[F.count_if(F.col(c)).alias(c) for c in ("moved_warm", "moved_cold", "purged")])


def tier_stats(logs: DataFrame) -> DataFrame:
    """Rows per tier and in total."""
    return logs.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("hot", "warm", "cold")],
                    F.count("*").alias("total"))


class TieredTable:
    """A log table in folders by tier, day and write, of which a version file names those that count.

    Every write goes to folders of its own, which no reader sees until one small file with the next version
    number is renamed into place. Rows that were there before the first version stay where they are until they age. A run that ends anywhere before that leaves the table as it was, one that ends
    later has changed it as a whole; either way a run after it finds each row once. Folders that neither
    of the last two versions names are removed by ``sweep``, so readers of the version before still find theirs.
    Only the job that ages and the jobs that append write; of two that begin from the same version one fails and can run again.

    The driver handles names of folders, one per tier, day and write not yet aged, and no rows.
    """

    VERSIONS, HELD = "_versions", "held"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def version(self) -> int:
        """The newest version, 0 where there is none yet."""
        return max((int(n) for n in self._names(self.VERSIONS) if n.isdigit()), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        """The folders of a version, by default the newest. A table without versions consists of the folders it has."""
        version = self.version() if version is None else version
        if version:
            lines = self.spark.read.text(f"{self.path}/{self.VERSIONS}/{version:010}").collect()
            return sorted(r["value"] for r in lines)
        return self._plain()

    def _plain(self) -> list[str]:
        return [f"{t}/{d}" for t in self._names("") if t.startswith("tier=") for d in self._names(t) if d.startswith("day=")]

    @staticmethod
    def tier_and_day(folder: str) -> tuple[str, str]:
        tier, day = folder.removeprefix(f"{TieredTable.HELD}/").split("/")[:2]
        return tier.partition("=")[2], day.partition("=")[2]

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """The rows of the table, or of some of its folders, with ``tier`` and ``day``."""
        folders = self.folders() if folders is None else folders
        plain, held = [f for f in folders if f.startswith("tier=")], [f for f in folders if f.startswith(self.HELD)]
        parts = [self.spark.read.option("basePath", root).parquet(*(f"{self.path}/{f}" for f in some))
                 for root, some in ((self.path, plain), (f"{self.path}/{self.HELD}", held)) if some]
        if not parts:
            raise ValueError(f"no rows in {self.path}")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return rows.drop("write")

    def write(self, rows: DataFrame) -> list[str]:
        """Rows with ``tier`` and ``day`` in new folders that no version names yet."""
        name = uuid.uuid4().hex
        rows.withColumn("write", F.lit(name)).write.mode("append").partitionBy("tier", "day", "write").parquet(f"{self.path}/{self.HELD}")
        days = [f"{self.HELD}/{t}/{d}" for t in self._names(self.HELD) if t.startswith("tier=") for d in self._names(f"{self.HELD}/{t}")]
        return [f"{d}/write={name}" for d in days if self.fs.exists(self._path(f"{d}/write={name}"))]

    def commit(self, base: int, folders: list[str]) -> None:
        """Make ``folders`` the version after ``base``."""
        draft = f"{self.VERSIONS}/.draft-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(draft), False)
        try:
            out.write(bytearray("".join(f"{f}\n" for f in sorted(folders)), "utf-8"))
        finally:
            out.close()
        final = self._path(f"{self.VERSIONS}/{base + 1:010}")
        if self.fs.exists(final) or not self.fs.rename(self._path(draft), final):
            self.fs.delete(self._path(draft), False)
            raise RuntimeError(f"{self.path} has changed since version {base}; run again")

    def sweep(self) -> list[str]:
        """Remove the folders that neither of the last two versions names, and older version files."""
        version = self.version()
        if not version:
            return []
        # Before the first version the table was what it had in plain folders.
        named = {f for v in (version, version - 1) for f in self.folders(v)} if version > 1 else {*self.folders(1), *self._plain()}
        days = [f"{self.HELD}/{t}/{d}" for t in self._names(self.HELD) if t.startswith("tier=") for d in self._names(f"{self.HELD}/{t}")]
        gone = [f for f in (*self._plain(), *(f"{d}/{w}" for d in days for w in self._names(d))) if f not in named]
        for f in gone:
            self.fs.delete(self._path(f), True)
        for v in self._names(self.VERSIONS):
            if v.isdigit() and int(v) < version - 1:
                self.fs.delete(self._path(f"{self.VERSIONS}/{v}"), False)
        return gone


def append_rows(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add log rows to a tiered table; rows without a tier are hot. They are there as a whole or not at all."""
    table = TieredTable(spark, path)
    base = table.version()
    have = table.folders(base)
    rows = rows if "tier" in rows.columns else rows.withColumn("tier", F.lit("hot"))
    table.commit(base, have + table.write(rows.withColumn("day", F.to_date("timestamp"))))


def age_table(
    spark: SparkSession, path: str, *, now: str, hot_days: float = 7, warm_days: float = 30, cold_days: float = 365,
) -> dict[str, list[str]]:
    """Run one cycle on a tiered log table (``TieredTable``).

    Only days with rows on the wrong side of a border are read; days that are past the last border as a
    whole go without being read. The rows of the days read are written to new folders, then one
    version takes these in place of the old ones. A cycle that ends before, at or after any step can be run again and ends
    with the same rows. Returns the days read and removed.
    """
    table = TieredTable(spark, path)
    base = table.version()
    folders = table.folders(base)
    have: dict[str, dict[str, list[str]]] = {tier: {} for tier in TIERS}
    for f in folders:
        tier, day = table.tier_and_day(f)
        have[tier].setdefault(day, []).append(f)
    border = {tier: dt.datetime.fromisoformat(str(now)) - dt.timedelta(days=n)
              for tier, n in zip(TIERS, (hot_days, warm_days, cold_days))}
    late = {tier: {d for d in have[tier] if dt.datetime.fromisoformat(d) < border[tier]} for tier in TIERS}
    whole = {d for d in late["cold"] if dt.datetime.fromisoformat(d) + dt.timedelta(days=1) <= border["cold"]}
    whole -= have["hot"].keys() | have["warm"].keys()
    read = sorted(set().union(*late.values()) - whole)
    old = [f for tier in TIERS for d in (*read, *whole) for f in have[tier].get(d, [])]
    if old:
        new: list[str] = []
        if read:
            rows = table.read([f for f in old if table.tier_and_day(f)[1] in set(read)])
            aged = retention_tiers(rows, now=now, hot_days=hot_days, warm_days=warm_days, cold_days=cold_days)
            new = table.write(aged.filter(~F.col("purged")).select(*rows.columns))
        table.commit(base, [f for f in folders if f not in set(old)] + new)
    table.sweep()
    return {"read": read, "removed": sorted(whole)}
