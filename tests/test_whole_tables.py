"""Queries read their tables whole."""

import __spark_entry__ as e
from ledgerloom.sources import testdata as td


def test_capabilities_know_the_cash_of_all_accounts(spark):
    sf = "/root/testdata/sf0.001"
    got = e.queries()["capabilities"](spark, sf)
    events = td.cash_events(spark, sf)
    for capability, types in (("cash_flow", ("DEPOSIT", "WITHDRAWAL")), ("income", ("DIVIDEND", "DISTRIBUTION", "INTEREST"))):
        there = {r.account_id for r in got.where("available").where(f"capability = '{capability}'").select("account_id").collect()}
        want = {r.account_id for r in events.where(events.type.isin(*types)).select("account_id").distinct().collect()}
        assert there == want and any(a % 3 == 0 for a in want)
