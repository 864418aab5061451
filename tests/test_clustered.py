"""Tables clustered by a hash of the key: lookups, changes, and the search index."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import hospital, patient
from wardflow.operators import profile, reports, updates
from wardflow.operators.search import PatientIndex
from wardflow.sources.clustered import ClusteredTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id")).alias("value"))
    return ClusteredTable.create(rows, f"{tmp_path}/t", "id", 16)


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(f"{table.path}/data") for f in names
            if f.endswith(".parquet")}


def values(df):
    return {r.id: r.value for r in df.collect()}


def test_a_lookup_reads_one_bucket(table):
    found = table.lookup(77)
    assert values(found) == {77: "v77"}
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    assert len(found.inputFiles()) <= len(table.rows().inputFiles()) / 8
    assert values(table.lookup(1, 2, 5000)) == {1: "v1", 2: "v2"}
    assert table.lookup(5000).count() == 0


def test_changes_leave_other_files_alone(spark, table):
    before = files(table)
    old = table.rows()
    table.upsert(spark.createDataFrame([(5, "new"), (9999, "added")], "id long, value string"))
    table.delete(spark.createDataFrame([(6,), (123456,)], "id long"))
    again = ClusteredTable(spark, table.path)
    assert again.version == 3
    wanted = {i: f"v{i}" for i in range(1000) if i != 6} | {5: "new", 9999: "added"}
    assert values(again.rows()) == wanted == values(table.rows())
    # No old file changed, and most are still those that are read.
    after = files(table)
    assert all(after[f] == t for f, t in before.items())
    still = {f.removeprefix("file:").replace("///", "/") for f in again.rows().inputFiles()}
    assert len(still & set(before)) >= 11
    assert len(values(old)) == 1000  # the version read before


def test_a_change_that_breaks_off_leaves_the_old_table(spark, table):
    def broken(rows):
        return rows.withColumn("value", F.raise_error(F.lit("broken off")).cast("string"))

    with pytest.raises(Exception, match="broken off"):
        table.change(spark.createDataFrame([(5,)], "id long"), broken)
    assert values(ClusteredTable(spark, table.path).rows()) == {i: f"v{i}" for i in range(1000)}


def test_two_writers_cannot_write_the_same_version(spark, table):
    other = ClusteredTable(spark, table.path)
    rows = spark.createDataFrame([(1, "x")], "id long, value string")
    table.upsert(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        other.upsert(rows)


def test_empty_tables_and_null_keys(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, value string")
    table = ClusteredTable.create(empty, f"{tmp_path}/e", "id", 4)
    assert table.rows().collect() == [] and table.lookup(1).collect() == []
    table.upsert(spark.createDataFrame([(None, "n"), (1, "a")], "id long, value string"))
    assert len(ClusteredTable(spark, table.path).rows().collect()) == 2
    with pytest.raises(FileNotFoundError):
        ClusteredTable(spark, f"{tmp_path}/nowhere")


def test_a_key_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        rows = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("id"), F.uuid().alias("value"))
        table = ClusteredTable.create(rows, f"{tmp_path}/hot", "id", 4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(files(table)) > 1 and table.rows().count() == 40_000


# -- search index -------------------------------------------------------------------

NAMES = [("Ann", "Lee"), ("anna", "Leeds"), ("Bo", "X"), ("José", "Álvarez"), ("", ""),
         ("Al", "Ann Lee"), ("o", "b"), ("O'Neil", "von der Au"), ("Ann", "Lee")]


@pytest.fixture(scope="module")
def people(spark):
    rows = [{**patient(f"P{i}", date(1980 + i % 3, 1 + i % 12, 7)), "first_name": a, "last_name": b}
            for i, (a, b) in enumerate(NAMES * 20)]
    rows.append({"patient_id": "none", "first_name": None, "last_name": "Lee"})
    return hospital(spark, patients=rows)


@pytest.fixture(scope="module")
def index(people, tmp_path_factory):
    return PatientIndex.build(people["patients"], str(tmp_path_factory.mktemp("index")), 16)


@pytest.mark.parametrize("term", ["", "a", "N", "nn", "ann", "Ann Lee", "LEE", "lee d", "é", "álv",
                                  "1981", "1981-0", "-07", "zzz", "b x", "o'neil", "  ", "%", "nowhere at all"])
def test_the_index_finds_what_the_scan_finds(people, index, term):
    def ids(df):
        return sorted(r.patient_id for r in df.collect())

    assert ids(index.search(term)) == ids(reports.search_patients(people, term))


def test_a_search_reads_fewer_rows(people, index):
    total = people["patients"].count()
    read = index.postings.lookup("von").count()
    assert 0 < read < total / 5
    assert index.candidates("von der").count() == 20
    assert index.candidates("xyz").count() == 0


# -- written back --------------------------------------------------------------------

def test_changes_written_back_equal_the_batch_job(spark, tmp_path):
    rows = [patient(f"P{i}", date(1980, 1, 1), phone="1") for i in range(50)]
    t = hospital(spark, patients=rows)
    changes = spark.createDataFrame(
        [(1, "P1", {"phone": "2"}), (2, "P1", {"city": None, "phone": "3"}), (3, "nobody", {"phone": "4"}),
         (4, "P7", {"first_name": None}), (5, "P9", {"last_name": "Z"})],
        "change_id long, patient_id string, fields map<string,string>")
    at = None
    whole, refused = updates.partial_update(t["patients"], changes, at)
    table = ClusteredTable.create(t["patients"], f"{tmp_path}/p", "patient_id", 32)
    before = set(files(table))
    assert sorted(r.change_id for r in updates.write_back_changes(table, changes, at).collect()) == sorted(
        r.change_id for r in refused.collect()) == [3, 4]
    drop = ["created_at", "updated_at"]
    assert not whole.drop(*drop).exceptAll(table.rows().drop(*drop)).count()
    still = {f.removeprefix("file:").replace("///", "/") for f in table.rows().inputFiles()}
    assert len(before - still) <= 2
    assert table.lookup("P1").first().phone == "3"


def test_a_profile_from_clustered_files_reads_few_of_them(spark, tmp_path):
    t = hospital(spark, patients=[patient(f"P{i}", date(1980, 1, 1)) for i in range(64)],
                 vitals=[{"vital_id": i, "patient_id": f"P{i % 64}", "recorded_at": datetime(2001, 5, 1)}
                         for i in range(640)])
    kept = {n: ClusteredTable.create(t[n], f"{tmp_path}/{n}", "patient_id", 16)
            for n in ("patients", *profile.SECTIONS)}
    own = {n: table.lookup("P3") for n, table in kept.items()}
    assert len(own["vitals"].inputFiles()) <= len(kept["vitals"].rows().inputFiles()) / 8
    wanted = profile.patient_profile(t, "P3").collect()
    assert profile.patient_profile(own, "P3").collect() == wanted and len(wanted[0].vitals) == 10
