"""The exact nearest customers against all pairs computed by brute force."""

import random
from dataclasses import replace
from datetime import date
from decimal import Decimal
from math import sqrt

import pytest

from tillroll.operators import recommend, similarity


def frame(spark, baskets):
    rows = [(c, i) for c, items in baskets.items() for i in items]
    return spark.createDataFrame(rows, "customer_id long, stock_code long")


def brute(baskets, n):
    out = set()
    for a, items in baskets.items():
        near = []
        for b, others in baskets.items():
            c = len(items & others)
            if a != b and c:
                near.append((-c * c / (len(items) * len(others)), b, c / sqrt(len(items) * len(others))))
        for rank, (_, b, cosine) in enumerate(sorted(near)[:n], 1):
            out.add((a, b, round(cosine, 9), rank))
    return out


def found(df):
    return {(r[0], r[1], round(r[2], 9), r[3]) for r in df.collect()}


def test_small_baskets(spark, retail):
    baskets = {1: {1, 2}, 2: {1, 2}, 3: {2, 3}, 4: {9}}
    got = found(similarity.nearest_customers(frame(spark, baskets), retail))
    assert (1, 2, 1.0, 1) in got and (2, 1, 1.0, 1) in got
    assert (1, 3, 0.5, 2) in got and (3, 1, 0.5, 1) in got and (3, 2, 0.5, 2) in got
    assert len(got) == 6, "nobody shares an item with customer 4"


def skewed(seed, people=60):
    """A third of the rows hold item 0, a third of the people own equal baskets."""
    draw = random.Random(seed)
    baskets = {}
    for c in range(people):
        if c % 3 == 0:
            baskets[c] = {0, 1}
        elif c % 7 == 0:
            baskets[c] = {0}
        else:
            baskets[c] = {draw.randrange(25) for _ in range(draw.randint(1, 7))} | (
                {0} if draw.random() < 0.5 else set()
            )
    return baskets


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [1000, 3])
def test_brute_force(spark, retail, seed, block):
    baskets = skewed(seed)
    settings = replace(retail, n_closest=3, pair_block=block)
    assert found(similarity.nearest_customers(frame(spark, baskets), settings)) == brute(baskets, 3)


def households(groups, own=12, crowded=30, seed=8):
    """Groups of nine share most of their own items; every crowded item is held by a third of all."""
    draw = random.Random(seed)
    baskets = {}
    for c in range(9 * groups):
        base = 1000 * (c // 9 + 1)
        baskets[c] = {base + k for k in range(own) if draw.random() < 0.9}
        baskets[c] |= {k for k in range(crowded) if draw.random() < 1 / 3}
    return baskets


def test_crowded_items_add_few_pairs(spark, retail):
    baskets = households(groups=20)
    settings = replace(retail, n_closest=3, pair_block=20)
    pairs = frame(spark, baskets)
    assert found(similarity.nearest_customers(pairs, settings)) == brute(baskets, 3)

    ranked = similarity.ranked_items(similarity.group_baskets(pairs, 3).items).cache()
    bar = similarity.bars(ranked, 3)
    inside = len(baskets) * 8  # a pair of one group, from either side
    meeting = sum(bool(baskets[a] & baskets[b]) for a in baskets for b in baskets if a != b)
    got = similarity.candidate_pairs(ranked, bar, 20).count()
    assert meeting > 15 * inside, "crowded items make nearly everybody meet"
    assert got <= 2 * inside, "few pairs outside the groups can reach the bars"
    ranked.unpersist()


def test_bars_are_reached_by_the_neighbours(spark):
    baskets = skewed(6)
    n = 3
    grouped = similarity.group_baskets(frame(spark, baskets), n)
    bar = {r["class_id"]: r["bar"] for r in similarity.bars(similarity.ranked_items(grouped.items), n).collect()}
    names = {frozenset(items): min(c for c in baskets if baskets[c] == items) for items in baskets.values()}
    for items, name in names.items():
        near = sorted((-len(items & o) ** 2 / (len(items) * len(o)) for o in names if o != items and items & o))
        if name in bar:
            assert -near[n] >= bar[name] * (1 - 1e-9)


@pytest.mark.parametrize("block", [1000, 2])
def test_nobody_shares_or_nothing_at_all(spark, retail, block):
    settings = replace(retail, n_closest=3, pair_block=block)
    apart = {c: {c, c + 100} for c in range(6)}
    assert found(similarity.nearest_customers(frame(spark, apart), settings)) == set()
    empty = spark.createDataFrame([], "customer_id long, stock_code long")
    assert found(similarity.nearest_customers(empty, settings)) == set()


def test_crowded_items_only(spark, retail):
    draw = random.Random(5)
    baskets = {c: {draw.randrange(30) for _ in range(8)} for c in range(50)}
    settings = replace(retail, n_closest=4, pair_block=4)
    assert found(similarity.nearest_customers(frame(spark, baskets), settings)) == brute(baskets, 4)


def test_whole_rows_of_targets(spark):
    baskets = skewed(9)
    targets = spark.createDataFrame([(0,), (7,), (11,)], "customer_id long")
    got = {
        (r["customer_id"], r["neighbour_id"], round(r["similarity"], 9))
        for r in similarity.similarity_to(frame(spark, baskets), targets).collect()
    }
    assert got == {row[:3] for row in brute(baskets, 10**6) if row[0] in (0, 7, 11)}
    pairs = {(a, b): s for a, b, s in got}
    assert all(0 < s <= 1 for s in pairs.values())
    assert all(pairs[(b, a)] == s for (a, b), s in pairs.items() if (b, a) in pairs)


def test_nearest_items(spark, retail):
    baskets = skewed(2, people=30)
    holders = {}
    for c, items in baskets.items():
        for i in items:
            holders.setdefault(i, set()).add(c)
    settings = replace(retail, n_closest=2)
    assert found(similarity.nearest_items(frame(spark, baskets), settings)) == brute(holders, 2)


def lines(spark, baskets, seed=1):
    draw = random.Random(seed)
    rows = [
        (c, i, f"item {i}", draw.randint(1, 9), Decimal(draw.randint(100, 999)) / 100, date(2011, 9, 1))
        for c, items in baskets.items()
        for i in items
        for _ in range(draw.randint(1, 3))
    ]
    schema = (
        "customer_id long, stock_code long, description string, quantity int, "
        "sales decimal(18,2), invoice_date date"
    )
    return rows, spark.createDataFrame(rows, schema)


def test_offers(spark, retail):
    baskets = skewed(3, people=40)
    rows, sales = lines(spark, baskets)
    settings = replace(retail, n_closest=3, n_return=4, pair_block=3)
    near = {}
    for a, b, _, _ in brute(baskets, 3):
        near.setdefault(a, set()).add(b)

    def expected(new_only):
        out = set()
        for a, others in near.items():
            groups = {}
            for c, i, _, q, s, _ in rows:
                if c in others and not (new_only and i in baskets[a]):
                    groups.setdefault(i, []).append((q, float(s)))
            means = [(-sum(s for _, s in g) / len(g), i, sum(q for q, _ in g) / len(g)) for i, g in groups.items()]
            means = sorted((round(m, 9), i, q) for m, i, q in means)
            for rank, (m, i, q) in enumerate(means[:4], 1):
                out.add((a, i, round(q, 6), round(-m, 6), rank))
        return out

    for new_only in (False, True):
        got = {
            (r["customer_id"], r["stock_code"], round(r["mean_quantity"], 6), round(r["mean_sales"], 6), r["rank"])
            for r in recommend.opportunities(sales, settings, new_only).collect()
        }
        assert got == expected(new_only)


def test_new_items_only(spark, retail):
    baskets = {1: {1, 2}, 2: {1, 2}, 3: {2, 3}, 4: {9}}
    _, sales = lines(spark, baskets)
    offers = recommend.recommendations(sales, retail)
    assert [r["stock_code"] for r in offers.filter("customer_id = 1").collect()] == [3]
    assert recommend.offer_text(offers).filter("customer_id = 1").first()["products"] == "item 3"
    assert offers.filter("customer_id = 4").isEmpty()
