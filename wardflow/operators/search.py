"""Patient search by an index of three-letter pieces.

Names and dates of birth, folded and padded by two blanks of their own on either
side, are cut into all pieces of three characters. A posting says that a patient
has a piece; postings are clustered by piece, patients by id. A term's rarest
pieces are looked up, their patients intersected, and only the buckets of those
patients are read, to compare the whole term. Terms of one or two characters are
found in the pieces that hold them: thanks to the padding every such part of a text
lies in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions import exprs as E
from wardflow.operators.reports import contains_term
from wardflow.sources.clustered import ClusteredTable

SIZE = 3
BUCKETS = 64
# Pieces of a term that are looked up: more cost more postings than they rule out.
RAREST = 3
_PAD = "\x02"


def _pieces(text: Column) -> Column:
    """All pieces of a padded text, each once; none for NULL."""
    padded = F.concat(F.lit(_PAD * (SIZE - 1)), F.lower(text), F.lit(_PAD * (SIZE - 1)))
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - SIZE + 1),
                      lambda i: F.substring(padded, i, F.lit(SIZE)))
    return F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))


@dataclass(frozen=True)
class PatientIndex:
    """Postings (``piece``, ``patient_id``), numbers of postings, and the patients."""

    postings: ClusteredTable
    counts: ClusteredTable
    patients: ClusteredTable

    @classmethod
    def build(cls, patients: DataFrame, path: str, buckets: int = BUCKETS) -> PatientIndex:
        born = F.date_format("date_of_birth", "yyyy-MM-dd")
        posting = patients.select("patient_id", F.explode(F.array_distinct(F.concat(
            _pieces(E.full_name()), _pieces(born)))).alias("piece"))
        postings = ClusteredTable.create(posting, f"{path}/postings", "piece", buckets)
        counted = postings.rows().groupBy("piece").agg(F.count(F.lit(1)).alias("patients"))
        return cls(postings, ClusteredTable.create(counted, f"{path}/counts", "piece", buckets),
                   ClusteredTable.create(patients, f"{path}/patients", "patient_id", buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PatientIndex:
        return cls(*[ClusteredTable(spark, f"{path}/{name}")
                     for name in ("postings", "counts", "patients")])

    def candidates(self, term: str) -> DataFrame:
        """Ids of all patients that may hold the term, and few others."""
        if len(term) < SIZE:
            return (self.postings.rows().filter(F.contains("piece", F.lit(term)))
                    .select("patient_id").distinct())
        pieces = sorted({term[i:i + SIZE] for i in range(len(term) - SIZE + 1)})
        held = {r["piece"]: r["patients"] for r in self.counts.lookup(*pieces).collect()}
        rarest = sorted(pieces, key=lambda p: (held.get(p, 0), p))[:RAREST]
        if not all(p in held for p in rarest):
            return self.patients.rows().select("patient_id").limit(0)
        return (self.postings.lookup(*rarest).groupBy("patient_id")
                .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(rarest))
                .select("patient_id"))

    def search(self, term: str) -> DataFrame:
        """Patients whose name, or date of birth as ISO text, contains the term."""
        term = term.lower()
        if not term:
            return self.patients.rows().filter(contains_term(term))
        return self.patients.semi(self.candidates(term)).filter(contains_term(term))
