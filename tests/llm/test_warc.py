import pytest
from pyspark.sql import functions as F

from brisa.llm import warc


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i % 5)) for i in range(300)]
    rows += [(300, None, None), (301, "u", ""), (301, "u", ""), (None, "u", "x"), (302, "u", "é" * 5000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS place", "2 AS file")


def test_manifest_has_the_places_of_the_written_file(pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 100)
    rows = sorted(warc.manifest(pages).collect(), key=lambda r: (r["file"], r["record_no"]))
    assert [(r["file"], r["record_no"]) for r in rows] == [(i // 100, i % 100) for i in range(305)]
    whole = pages.select("page_id", warc.record(F.col("url"), F.col("page_id"), F.col("html")).alias("r")).collect()
    sizes = {r["page_id"]: len(r["r"].encode()) for r in whole}
    at = {}
    for r in rows:
        assert r["offset"] == at.get(r["file"], 0) and r["length"] == sizes[r["page_id"]]
        at[r["file"]] = r["offset"] + r["length"]


@pytest.mark.parametrize("fan", [2, 16])
def test_audit_finds_the_damage_and_nothing_else(pages, monkeypatch, fan):
    monkeypatch.setattr(warc, "FILE_RECORDS", 100)
    monkeypatch.setattr(warc, "FAN", fan)
    primary = warc.manifest(pages)
    assert warc.audit(primary, primary).count() == 0
    place = F.col("file") * 100 + F.col("record_no")
    replica = primary.where(place != 7).withColumn("sha256", F.when(place.isin(0, 150, 304), "bad").otherwise(F.col("sha256")))
    replica = replica.withColumn("offset", F.when(place == 99, F.col("offset") + 1).otherwise(F.col("offset")))
    extra = primary.where(place == 304).withColumn("record_no", F.lit(50).cast("long"))
    found = warc.audit(primary, replica.unionByName(extra)).select("file", "record_no", "status").collect()
    want = {(0, 0, "changed"), (0, 7, "missing"), (0, 99, "changed"), (1, 50, "changed"), (3, 4, "changed"), (3, 50, "unknown")}
    assert {tuple(r) for r in found} == want


def test_a_lost_file_and_an_empty_archive(pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 100)
    primary = warc.manifest(pages)
    assert {r["status"] for r in warc.audit(primary, primary.where("file <> 1")).collect()} == {"missing"}
    none = warc.manifest(pages.where("false"))
    assert warc.audit(none, none).count() == 0
    assert warc.audit(primary, none).count() == 305
