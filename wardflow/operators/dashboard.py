"""The dashboard and the age distribution, kept current over batches of changes.

The counts per patient are kept in files clustered by patient. A batch names the
patients it touches; their counts are made anew from their own rows and replace the
old ones, in their buckets only. Totals are sums over the kept counts, which are a
few numbers per patient, so no batch makes the tables be read again as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators import reports
from wardflow.session import settle
from wardflow.sources.clustered import ClusteredTable

Tables = Mapping[str, DataFrame]

# Tables whose rows are counted.
COUNTED = ("patients", "vitals", "medical_history", "delivery_information", "follow_up_visits")
BUCKETS = 256


class Dashboard:
    """Counts per patient as of one date, under a folder of their own."""

    def __init__(self, counts: ClusteredTable, as_of: date):
        self._counts, self._as_of = counts, as_of

    @classmethod
    def create(cls, t: Tables, as_of: date, path: str, buckets: int = BUCKETS) -> Dashboard:
        return cls(ClusteredTable.create(reports.patient_partials(t, as_of), path, "patient_id",
                                         buckets), as_of)

    @classmethod
    def open(cls, spark: SparkSession, path: str, as_of: date) -> Dashboard:
        return cls(ClusteredTable(spark, path), as_of)

    def refresh(self, t: Tables, touched: DataFrame) -> None:
        """Count the patients of ``touched`` (``patient_id``) anew.

        ``t`` holds the tables after the batch, as a whole or only the rows of those
        patients, as read by key from clustered tables. Patients that are no
        longer there lose their counts, new ones get theirs.
        """
        # Written, as it meets every table: the batch's rows would be made distinct for each.
        touched = settle(touched.select("patient_id").filter(F.col("patient_id").isNotNull())
                         .distinct(), "touched-patients")
        own = {name: t[name].join(touched, "patient_id", "left_semi") for name in COUNTED}
        new = reports.patient_partials(own, self._as_of)
        self._counts.change(touched, lambda old: old.join(
            touched, "patient_id", "left_anti").unionByName(new))

    def totals(self) -> DataFrame:
        return reports.totals_of(self._counts.rows())

    def age_distribution(self) -> DataFrame:
        return reports.ages_of(self._counts.rows())
