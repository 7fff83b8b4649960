"""The stand-in views reproduce the facts FIXTURES.md measured."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from rollcall.operators import coverage, parse, state
from rollcall.sources import views

FACTS = {
    # sf: (check-ins, with no IP, with no MAC, headless clusters, clusters)
    SF_SMALL: (199, 3, 3, 9, 10),
    SF_MID: (2017, 50, 31, 5, 25),
}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_view_facts(spark, sf):
    n, no_ip, no_mac, headless, clusters = FACTS[sf]
    pc = parse.parse_checkins(views.checkins(spark, sf))
    assert pc.count() == n
    assert pc.where(F.col("ip").isNull()).count() == no_ip
    assert pc.where(F.col("mac").isNull()).count() == no_mac
    fleet = views.fleet(spark, sf)
    heads = state.head_nodes(fleet)
    assert heads.count() == clusters
    assert heads.where(F.col("head_idx").isNull()).count() == headless
    cov = coverage.report_coverage(fleet, pc)
    assert cov.where("pending = 0").count() == clusters
    wide = coverage.report_coverage(views.fleet_wide(spark, sf), pc)
    assert wide.where("pending = 0").count() == 0


def test_fleet_view_positions(spark):
    fleet = views.fleet(spark, SF_MID)
    per = fleet.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo"),
                                       F.max("idx").alias("hi"),
                                       F.countDistinct("idx").alias("d"))
    assert per.where("lo != 0 OR hi != n - 1 OR d != n").count() == 0
