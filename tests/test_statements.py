"""Lines that look like others in statements."""

from ledgerloom.sources import statements


def test_headings_with_a_name_before_and_rows_that_speak_of_them(spark):
    text = ["Your portfolio valuation as at 30 June 2020", "Managed funds", "ABC Australian shares index 10.00 2.00 30-Jun-20 20.00", "Somebank Cash Account", "CASH Balance held 5.00 1.00 30-Jun-20 5.00", "Australian shares", "XYZ Some share 1.00 3.00 30-Jun-20 3.00", "Your cash account transaction details"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(text)], "document_id int, page int, line_no int, text string")
    got = statements.extract_holdings(statements.tag_sections(lines)).collect()
    assert [(r.code, r.asset_class, float(r.value)) for r in got] == [("ABC", "managed_fund", 20.0), ("XYZ", "australian_share", 3.0)]


def test_summary_takes_its_own_lines(spark):
    text = ["Deposits in transit to bank 9.00", "Deposits into Some Cash Account 120.50", "Withdrawals pending 4.00", "Withdrawals from Some Cash Account 20.25", "Assets transferred in 7.00", "Change in investment value 33.10", "Withholding tax 1.10", "Return after withholding tax and fees 31.00"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(text)], "document_id int, page int, line_no int, text string")
    (got,) = statements.extract_summary(lines).collect()
    assert [float(got[k]) for k in ("deposits", "withdrawals", "transfers_in", "change_in_value", "withholding_tax", "reported_return")] == [120.5, 20.25, 7.0, 33.1, 1.1, 31.0] and got.transfers_out is None
