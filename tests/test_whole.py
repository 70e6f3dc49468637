"""Queries that keep all they find."""
from corrobora.functions import vocab as V
from corrobora.plans.catalog import load_all

SF = "/root/testdata/sf0.001"


def test_a_person_is_asked_about_by_every_angle(spark):
    got = {}
    for r in load_all()["B20_person_queries"].run(spark, SF).orderBy("entity_id", "pos").collect():
        got.setdefault(r["entity_id"], []).append((r["pos"], r["query"]))
    assert len(got) == spark.read.parquet(f"{SF}/customer.parquet").count()
    for asked in got.values():
        base = asked[0][1]
        assert asked == list(enumerate([base, *(f"{base} {a}" for a in V.PERSON_ANGLES)]))
