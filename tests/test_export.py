"""The whole export as files: every field, and metadata that agrees with the rows that were written."""

import pyspark.errors
import pytest
from pyspark.sql import functions as F

from tessera.operators import export
from tessera.plans import exports

SF = "/root/testdata/sf0.001"
FIELDS = """id name address zip state lat lon phone website hoursRaw services accessRequirements languages ai reliability nearestTransit transit neighborhood city foodTypes nearestTransitType
nearestTransitLines transitDistanceMeters weatherAlert sourceId sourceName sourceIds crossSourceCount acceptsFoodDonations acceptsMoneyDonations acceptsVolunteers donateUrl volunteerUrl urgency createdAt updatedAt""".split()


def test_metadata_agrees_with_the_records(spark, tmp_path):
    rows = exports._whole(spark, SF)
    assert rows.columns == FIELDS
    path = str(tmp_path / "export")
    export.write_export(rows, path)
    told = {(r["kind"], r["name"]): r["n"] for r in export.read_metadata(spark, path).collect()}
    kept = spark.read.schema(rows.schema).json(f"{path}/records")
    counted = kept.agg(*[F.count_if(c).alias(n) for n, c in export.coverage().items()]).first().asDict()
    assert told == {("total", "organizations"): kept.count(), **{tuple(n.split(".")): k for n, k in counted.items()}}
    assert sum(n for (kind, _), n in told.items() if kind == "bySource") == told["total", "organizations"]


def test_no_metadata_for_records_that_failed(spark, tmp_path):
    broken = exports._whole(spark, SF).withColumn("name", F.when(F.col("id") % 50 == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        export.write_export(broken, str(tmp_path / "export"))
    with pytest.raises(pyspark.errors.AnalysisException):
        export.read_metadata(spark, str(tmp_path / "export"))
