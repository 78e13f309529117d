"""Reports U1-U5 on literal lines: filters, NULL handling, rounding, tie-breaks."""

from tillroll.operators import reports
from helpers import lines

ROWS = [
    # InvoiceNo, StockCode, Description, Qty, date, price, CustomerID, Country
    ("1", "A", "RED MUG", 2, "2011-01-05 10:00:00", 1.00, 10, "UK"),
    ("1", "B", "RED PLATE", 1, "2011-01-05 10:00:00", 1.01, 10, "UK"),
    ("2", "A", "RED MUG", 3, "2012-01-20 09:00:00", 1.00, 10, "UK"),
    ("3", "C", None, 5, "2011-02-01 08:00:00", 2.50, None, "UK"),
    ("4", "D", " LEADING BLANK", 1, "2011-02-01 08:00:00", 4.00, 20, "FR"),
    ("5", "A", "RED MUG", -7, "2011-02-02 08:00:00", 1.00, 20, "FR"),
]


def test_revenue_by_country_keeps_guests_and_drops_returns(spark):
    out = {r.Country: r for r in reports.revenue_by_country(lines(spark, ROWS)).collect()}
    uk = out["UK"]
    assert uk.TotalRevenue == 18.51  # 2.00 + 1.01 + 3.00 + 12.50, exact DECIMAL sum
    assert uk.NumberOfCustomers == 1  # the guest line counts for revenue, not customers
    assert uk.NumberOfOrders == 3
    assert out["FR"].TotalRevenue == 4.0 and out["FR"].NumberOfOrders == 1


def test_monthly_revenue_keeps_year(spark):
    months = [r.Month for r in reports.monthly_revenue(lines(spark, ROWS)).collect()]
    assert months == ["2011-01", "2011-02", "2012-01"]


def test_customer_frequency_mean_line_value_and_active_months(spark):
    out = {r.CustomerID: r for r in reports.customer_frequency(lines(spark, ROWS)).collect()}
    c10 = out[10]
    assert None not in out  # guest lines dropped here only
    # lines 2.00, 1.01, 3.00 -> mean 2.003333 -> 2.00 ; January 2011 and 2012 = one month
    assert c10.AverageOrderValue == 2.0
    assert c10.NumberOfActiveMonths == 1
    assert c10.NumberOfOrders == 2


def test_mean_rounds_exact_half_cent_away_from_zero(spark):
    rows = [("1", "A", "X", 1, "2011-01-01 00:00:00", 1.00, 1, "UK"),
            ("1", "B", "X", 1, "2011-01-01 00:00:00", 1.01, 1, "UK")]
    (r,) = reports.customer_frequency(lines(spark, rows)).collect()
    assert r.AverageOrderValue == 1.01  # 1.005 exactly; a double mean would give 1.0


def test_category_first_word_null_and_blank(spark):
    out = {r.Category: r for r in reports.category_revenue(lines(spark, ROWS)).collect()}
    assert out["RED"].ProductCount == 3  # lines, not products
    assert out[None].CategoryRevenue == 12.5
    assert out[""].CategoryRevenue == 4.0


def test_top_products_tie_break_by_stock_code(spark):
    rows = [("1", s, "ITEM", 5, "2011-01-01 00:00:00", 1.0, 1, "UK") for s in "EDCBA"]
    out = [r.StockCode for r in reports.top_products(lines(spark, rows), n=3).collect()]
    assert out == ["A", "B", "C"]


def test_run_report_on_registered_view(spark):
    from tillroll.sources.transactions import register

    register(lines(spark, ROWS), "online_retail")
    assert reports.run_report(spark, "revenue_by_country").count() == 2
