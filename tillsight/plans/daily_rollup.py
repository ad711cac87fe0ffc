"""Sums per branch, section and day, kept beside the sales and folded again only where these changed.

The table lies in the shared folder, one folder per sale date, and outlives the
session.  Its rows carry the version of the sales they were folded from, which
the names, sizes and times of the stored files and the sections of the products
make up.  Whoever asks for the sums lists the files; a date whose version differs
is folded again, a date that is gone is dropped, the others are read as they are.
Sums and versions are written together, so a refresh that breaks off leaves dates
that are plainly out of date.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, functions as F

from ..operators import root_cause as rca
from ..session import drop_path, path_exists, shared_folder
from ..sources.readers import Star
from ..sources.schemas import NO_DATE, SALE_DATE

COLUMNS = ("branch_id", "product_id", "timestamp", "net_amount", "discount_amount")
# Part of the folder's name: tables of another layout are left alone.
LAYOUT = "section-sums-1"
_SCHEMA = (
    "branch_id int, section_id int, day date, net_amount decimal(38,4), discount_amount decimal(38,4), "
    f"version string, {SALE_DATE} date"
)
Days = tuple[dt.date, dt.date]


class DailyRollup:
    """The kept sums of one star.

    One job refreshes a table at a time.  Frames given out read the files of
    their refresh; after a later one they have to be asked for again.
    """

    def __init__(self, star: Star, path: str | None = None) -> None:
        self.star = star
        self.spark = star.products.sparkSession
        mark = hashlib.md5((star.location or "").encode()).hexdigest()
        self.path = path or f"{shared_folder(self.spark).rstrip('/')}/{LAYOUT}-{mark}"

    def _stored(self) -> DataFrame:
        if path_exists(self.spark, self.path):
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], _SCHEMA)

    def _within(self, frame: DataFrame, days: Days | None) -> DataFrame:
        return frame if days is None else frame.filter(F.col(SALE_DATE).between(*map(F.lit, days)))

    def _versions(self, days: Days | None) -> dict[dt.date | None, str]:
        """The present version of every sale date; a row for each date that has files."""
        mapping = self.star.products.agg(F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("product_id", "section_id"))))
        present = self._within(self.star.versions(), days).select(SALE_DATE, F.concat_ws("-", "version", mapping.scalar()))
        found = {row[0]: row[1] for row in present.collect()}
        if self.star.dated:
            found.pop(None, None)  # lines without a time
        return found

    def _drop(self, day: dt.date | None) -> None:
        drop_path(self.spark, f"{self.path}/{SALE_DATE}={day or NO_DATE}")

    def refresh(self, days: Days | None = None) -> list[dt.date | None]:
        """Folds what has changed, of all dates or those from the first to the last of ``days``.

        Returns the dates that were folded.  The only date of sales that are not
        stored by dates is None.
        """
        present = self._versions(days)
        held = {row[0]: row[1] for row in self._within(self._stored(), days).select(SALE_DATE, "version").distinct().collect()}
        for day in held.keys() - present.keys():
            self._drop(day)
        changed = sorted((d for d, v in present.items() if held.get(d) != v), key=str)
        if not changed:
            return []
        lines = self.star.dated_sales(*COLUMNS)
        if not self.star.dated:
            lines = lines.withColumn(SALE_DATE, F.lit(None).cast("date"))
        elif days is not None or len(changed) < len(present):
            lines = lines.filter(F.col(SALE_DATE).isin(*changed))
        versions = self.spark.createDataFrame([(d, present[d]) for d in changed], "changed date, version string")
        sums = rca.section_sums(lines, self.star.products, SALE_DATE)
        folded = sums.join(versions, F.col(SALE_DATE).eqNullSafe(F.col("changed")))
        (
            folded.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in _SCHEMA.split(", ")])
            .hint("rebalance", SALE_DATE)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(SALE_DATE)
            .parquet(self.path)
        )
        # A date that has lost all its lines has written nothing over its old sums.
        for day in self._outdated(changed, present, held):
            self._drop(day)
        return changed

    def _outdated(self, changed, present, held) -> list[dt.date | None]:
        rewritten = [d for d in changed if d in held]
        if not rewritten:
            return []
        stored = self._stored().select(SALE_DATE, "version").distinct().collect()
        return [row[0] for row in stored if row[0] in rewritten and row[1] != present[row[0]]]

    def section_days(self, days: Days | None = None) -> DataFrame:
        """The current sums with the sections' names."""
        self.refresh(days)
        sums = self._within(self._stored(), days).drop("version", SALE_DATE)
        return rca.with_section_names(sums, self.star.sections)
