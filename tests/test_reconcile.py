from datetime import date
from decimal import Decimal as D

from assurelake.operators import reconcile
from assurelake.plans.domain import Domain

PAY = "transaction_reference string, collecting_agency string, revenue_channel string, payment_date date, amount decimal(18,2), payment_status string, provider_reference string"
SET = "settlement_reference string, collecting_agency string, revenue_channel string, settlement_account string, settlement_date date, settled_amount decimal(18,2), settlement_status string"


def day(n):
    return date(2025, 1, n)


def test_statuses(spark):
    pay = [("KRA", "MPESA", 1, 1000, None), ("KRA", "BANK", 2, 2000, None), ("KRA", "CARD", 3, 3000, None), ("COUNTY", "MPESA", 4, 4000, None), ("COUNTY", "BANK", 5, 5000, None), ("COUNTY", "PARKING", 6, 700, "R"), ("COUNTY", "PARKING", 6, 700, "R")]
    settle = [("KRA", "MPESA", 2, 1000, None), ("kra", "card", 4, 1000, None), ("COUNTY", "MPESA", 10, 4000, None), ("COUNTY", "BANK", 6, 5000, "COMMERCIAL-BANK-123"), ("COUNTY", "PARKING", 7, 1400, None)]
    p = spark.createDataFrame([(f"t{i}", a, c, day(d), D(x), "paid", r) for i, (a, c, d, x, r) in enumerate(pay)], PAY)
    s = spark.createDataFrame([(f"s{i}", a, c, acc or reconcile.EXPECTED_ACCOUNT, day(d), D(x), "SETTLED") for i, (a, c, d, x, acc) in enumerate(settle)], SET)
    out = reconcile.reconcile(p, s).persist()
    got = sorted((r.collecting_agency, r.revenue_channel, r.settlement_status) for r in out.collect())
    assert got == [
        ("COUNTY", "BANK", "WRONG_ACCOUNT"), ("COUNTY", "MPESA", "DELAYED_SETTLEMENT"), ("COUNTY", "PARKING", "DUPLICATE_TRANSACTION"), ("COUNTY", "PARKING", "MATCHED"),
        ("KRA", "BANK", "MISSING_SETTLEMENT"), ("KRA", "CARD", "PARTIAL_SETTLEMENT"), ("KRA", "MPESA", "MATCHED"),
    ]
    assert reconcile.signals_of(out).count() == 5 and reconcile.exception_count(out).first()[0] == 5
    assert out.select("deterministic_key").distinct().count() == 7


def test_two_settlements_that_add_up_are_missing(spark):
    p = spark.createDataFrame([("t", "A", "C", day(1), D(1000), "PAID", None)], PAY)
    s = spark.createDataFrame([(f"s{i}", "A", "C", "x", day(2), D(x), "SETTLED") for i, x in enumerate((600, 400))], SET)
    assert reconcile.reconcile(p, s).first().settlement_status == "MISSING_SETTLEMENT"


def test_empty(spark):
    assert reconcile.reconcile(spark.createDataFrame([], PAY), spark.createDataFrame([], SET)).count() == 0


def test_payments_are_all_purchases(spark, sf):
    """Every purchase is a payment, so that windows of neighbouring days overlap."""
    d = Domain(spark, sf)
    assert d["payment_transactions"].count() == d["events"].filter("event_type = 'purchase'").count() > 0
    days = {r[0] for r in d["payment_transactions"].selectExpr("to_date(payment_date)").distinct().collect()}
    assert any(date.fromordinal(x.toordinal() + 1) in days for x in days)


def test_overlapping_windows(spark):
    """Each settlement answers every day in whose window it is."""
    pay = {1: 100, 2: 200, 3: 300, 4: 50}
    settle = [(2, 100), (3, 200), (6, 50)]
    p = spark.createDataFrame([(f"t{n}", "A", "C", day(n), D(x), "PAID", None) for n, x in pay.items()], PAY)
    s = spark.createDataFrame([(f"s{i}", "A", "C", reconcile.EXPECTED_ACCOUNT, day(n), D(x), "SETTLED") for i, (n, x) in enumerate(settle)], SET)
    want = {}
    for n, x in pay.items():
        near = [a for m, a in settle if n <= m <= n + 2]
        exact = [a for m, a in settle if n <= m <= n + reconcile.LATE_DAYS and a == x]
        late = not near and sum(exact) >= x
        status = "PARTIAL_SETTLEMENT" if near and sum(near) < x else "MISSING_SETTLEMENT" if not exact else "DELAYED_SETTLEMENT" if late else "MATCHED"
        want[day(n)] = (D(sum(exact if late else near)), status)
    assert {r.reconciliation_date: (r.settled_amount, r.settlement_status) for r in reconcile.reconcile(p, s).collect()} == want
    assert want[day(1)] == (300, "MATCHED")
