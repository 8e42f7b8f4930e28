"""Revisits of resources that differ in their query only."""

from weirflow.llm import queries, revisits

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string, length long"


def test_resources_of_one_path_stay_apart(spark):
    site = "http://www.a.org/item"
    rows = [
        (1, f"{site}?id=1&b=2", 10, "response", "one", None, None, "d1", 1), (2, f"{site}?id=2", 20, "response", "two", None, None, "d2", 2), (3, f"https://a.org/item/?b=2&id=1&utm_source=feed#top", 30, "revisit", "one", None, None, None, None),
        (4, f"{site}?id=1&b=2", 31, "revisit", None, None, None, None, None), (5, f"{site}?id=3", 32, "revisit", None, None, None, None, None), (6, f"{site}?id=A", 5, "response", None, None, None, "d6", 6), (7, f"{site}?id=a", 40, "revisit", None, None, None, None, None),
    ]
    got = {r.record_id: (r.url_key, r.outcome, r.response_id) for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {3: ("a.org/item?b=2&id=1", "resolved", 1), 4: ("a.org/item?b=2&id=1", "unvalidated", 1), 5: ("a.org/item?id=3", "no_response", None), 7: ("a.org/item?id=a", "no_response", None)}


def test_derived_revisits_keep_the_query(spark):
    pages = spark.createDataFrame([(12, "http://a.org/en/2112?page=2&ref=x", "two"), (13, "http://a.org/en/2112/", "one")], "page_id long, url string, html string")
    got = revisits.resolve_revisits(queries.page_records(pages)).where("record_id % 4 = 2").collect()
    assert [(r.record_id, r.outcome, r.response_id) for r in got] == [(50, "resolved", 48)]


def test_paths_keep_their_case_and_hosts_do_not(spark):
    rows = [(1, "http://WWW.a.org:80/Item?id=2", 1, "response", "x", None, None, "d1", 1), (2, "http://a.org/item?id=2", 2, "revisit", "x", None, None, None, None), (3, "https://A.ORG/Item?id=2", 3, "revisit", "x", None, None, None, None)]
    got = {r.record_id: (r.url_key, r.outcome) for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {2: ("a.org/item?id=2", "no_response"), 3: ("a.org/Item?id=2", "resolved")}


def test_header_names_that_differ_in_case_are_one_field(spark):
    rows = [(1, "a.org/x", 1, "response", "x", None, {"Via": "one", "via": "two", "Date": "old"}, "d", 1), (2, "a.org/x", 2, "revisit", "x", None, {"DATE": "a", "date": "b"}, None, None)]
    (r,) = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert r.headers == {"via": "one, two", "date": "a, b"}
