"""Case 1 jobs against the published answers on the diner fixture."""

import datetime as dt

import pytest

from conftest import rows
from fixtures import diner
from tillroll.plans import diner as J


@pytest.fixture(scope="module")
def t(spark):
    return diner(spark)


def test_j01_spend(t):
    assert rows(J.spend_per_customer(t["sales"], t["menu"])) == [("A", 76), ("B", 74), ("C", 36)]


def test_j02_days(t):
    assert rows(J.visit_days(t["sales"])) == [("A", 4), ("B", 6), ("C", 2)]


def test_j03_first_purchase_ties_kept_duplicates_removed(t):
    assert rows(J.first_purchase(t["sales"], t["menu"])) == [
        ("A", "curry"), ("A", "sushi"), ("B", "curry"), ("C", "ramen")]


def test_j04_most_purchased(t):
    assert rows(J.most_purchased(t["sales"], t["menu"])) == [("ramen", 8)]


def test_j05_favourite_three_way_tie(t):
    assert rows(J.favourite_items(t["sales"], t["menu"])) == [
        ("A", "ramen", 3), ("B", "curry", 2), ("B", "ramen", 2), ("B", "sushi", 2), ("C", "ramen", 3)]


def test_j06_first_after_joining_includes_join_day(t):
    assert rows(J.first_after_joining(t["sales"], t["members"], t["menu"])) == [
        ("A", "curry"), ("B", "sushi")]


def test_j07_last_before_joining(t):
    assert rows(J.last_before_joining(t["sales"], t["members"], t["menu"])) == [
        ("A", "curry"), ("A", "sushi"), ("B", "sushi")]


def test_j08_spend_before_joining(t):
    assert rows(J.spend_before_joining(t["sales"], t["members"], t["menu"])) == [
        ("A", 2, 25), ("B", 3, 40)]


def test_j09_points(t):
    assert rows(J.points(t["sales"], t["menu"], double_item="sushi")) == [
        ("A", 860), ("B", 940), ("C", 360)]


def test_j10_member_points_window_does_not_stack(t):
    out = J.member_points(t["sales"], t["menu"], t["members"], until="2021-01-31", double_item="sushi")
    assert rows(out) == [("A", 1370), ("B", 820)]


def test_j11_member_flag(t):
    out = rows(J.joined_table(t["sales"], t["menu"], t["members"]),
               "customer_id", "order_date", "product_name", "price", "member")
    d = dt.date
    assert out == sorted([
        ("A", d(2021, 1, 1), "curry", 15, "N"), ("A", d(2021, 1, 1), "sushi", 10, "N"),
        ("A", d(2021, 1, 7), "curry", 15, "Y"), ("A", d(2021, 1, 10), "ramen", 12, "Y"),
        ("A", d(2021, 1, 11), "ramen", 12, "Y"), ("A", d(2021, 1, 11), "ramen", 12, "Y"),
        ("B", d(2021, 1, 1), "curry", 15, "N"), ("B", d(2021, 1, 2), "curry", 15, "N"),
        ("B", d(2021, 1, 4), "sushi", 10, "N"), ("B", d(2021, 1, 11), "sushi", 10, "Y"),
        ("B", d(2021, 1, 16), "ramen", 12, "Y"), ("B", d(2021, 2, 1), "ramen", 12, "Y"),
        ("C", d(2021, 1, 1), "ramen", 12, "N"), ("C", d(2021, 1, 1), "ramen", 12, "N"),
        ("C", d(2021, 1, 7), "ramen", 12, "N"),
    ])


def test_j12_ranking_members_only(t):
    out = J.ranked_table(t["sales"], t["menu"], t["members"])
    got = sorted((r.customer_id, r.order_date.isoformat(), r.product_name, r.member,
                  -1 if r.ranking is None else r.ranking) for r in out.collect())
    assert got == sorted([
        ("A", "2021-01-01", "sushi", "N", -1), ("A", "2021-01-01", "curry", "N", -1),
        ("A", "2021-01-07", "curry", "Y", 1), ("A", "2021-01-10", "ramen", "Y", 2),
        ("A", "2021-01-11", "ramen", "Y", 3), ("A", "2021-01-11", "ramen", "Y", 3),
        ("B", "2021-01-01", "curry", "N", -1), ("B", "2021-01-02", "curry", "N", -1),
        ("B", "2021-01-04", "sushi", "N", -1), ("B", "2021-01-11", "sushi", "Y", 1),
        ("B", "2021-01-16", "ramen", "Y", 2), ("B", "2021-02-01", "ramen", "Y", 3),
        ("C", "2021-01-01", "ramen", "N", -1), ("C", "2021-01-01", "ramen", "N", -1),
        ("C", "2021-01-07", "ramen", "N", -1),
    ])


def test_rank_filter_is_cut_before_the_shuffle(t):
    plan = J.favourite_items(t["sales"], t["menu"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
