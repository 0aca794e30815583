from stockyard import schema as S
from stockyard.operators import star


def test_round_trip(inventory):
    dimensions = star.build_dimensions(inventory.fact)
    flat = inventory.fact.select(*S.FACT_COLUMNS)
    back = star.denormalize(star.normalize(flat, dimensions), dimensions)
    assert flat.exceptAll(back).count() == 0 and back.exceptAll(flat).count() == 0


def test_ids_are_stable_and_missing_values_are_dropped(facts):
    rows = facts({"category": "b"}, {"category": "a"}, {"category": None})
    dimensions = star.build_dimensions(rows)
    found = {r.category_name: r.category_id for r in dimensions["categories"].collect()}
    assert found == {"a": 1, "b": 2}
    fact = star.normalize(rows, dimensions)
    report = {r.check: (r.expected, r.actual, r.ok) for r in star.load_reconciliation(rows, fact).collect()}
    assert report == {"rows": (3, 2, False), "categories": (2, 2, True)}


def test_orphans_are_found(facts):
    rows = facts({"store_id": "a"}, {"store_id": "b"})
    dimensions = star.build_dimensions(rows)
    fact = star.normalize(rows, dimensions)
    dimensions["stores"] = dimensions["stores"].filter("store_id = 'a'")
    dimensions["promotions"] = dimensions["promotions"].filter("promotion_id = 1")
    report = {r.foreign_key: r.orphan_rows for r in star.star_schema_check(fact, dimensions).collect()}
    assert report.pop("store_id") == 1 and report.pop("promotion_id") == 2
    assert set(report.values()) == {0}


def test_names_that_a_lookup_lacks_are_orphans(facts):
    rows = facts({"category": "a"}, {"category": "b"}, {"category": "b", "holiday_promotion": 7})
    dimensions = star.build_dimensions(rows.filter("category = 'a'"))
    found = {r.foreign_key: (r.checked_rows, r.orphan_rows, r.orphan_values) for r in star.staging_check(rows, dimensions).collect()}
    assert found["category_id"] == (3, 2, 1) and found["promotion_id"] == (3, 1, 1)
    assert found["region_id"] == (3, 0, 0)
