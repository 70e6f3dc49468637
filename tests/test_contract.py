"""Every operator of the blueprint is registered, with a SQL twin or a stated reason."""
import re

import __spark_entry__ as E
from corrobora.plans.catalog import load_all

COUNTS = {"A": 13, "B": 36, "C": 36, "D": 25, "E": 11, "F": 5, "G": 7, "H": 8, "I": 11, "J": 9}


def test_every_operator_has_a_query():
    have = {re.match(r"[A-J]\d+", n).group(0) for n in load_all()}
    want = {f"{k}{i}" for k, n in COUNTS.items() for i in range(1, n + 1)}
    assert want - have == set()


def test_oracles_belong_to_queries_and_gaps_are_explained():
    assert set(E.oracle_sql()) <= set(E.queries())
    without = [e for e in load_all().values() if e.oracle is None]
    assert all(e.reason for e in without) and len(without) <= 5


def test_entry(spark):
    got = {r["label"]: r["n"] for r in E.entry(spark).collect()}
    assert set(got) == {"well-supported", "contested", "unverified", "disproven"} and sum(got.values()) > 0
