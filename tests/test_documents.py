"""Lists and dashboard over six documents, and parameters."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.operators import access, listing, load, text, vectors
from paperloom.operators.access import Caller

#: Documents of the example data (fixed values).
SCHEMA = "id long, name string, type string, size_kb long, status string, classification string, year long, uploaded_by long, workspace_id string, created_at timestamp_ntz"
ROWS = [
    (1, "Q3 Sector Performance Report.pdf", "PDF", 2840, "Ready", "Internal", 2026, 1),
    (2, "Annual Cybersecurity Threat Assessment.docx", "DOCX", 1520, "Needs Review", "Confidential", 2026, 2),
    (3, "Stakeholder Consultation Summary.pdf", "PDF", 880, "Ready", "Public", 2026, 1),
    (4, "Spectrum Auction Outcomes 2026.pdf", "PDF", 4120, "Processing", "Restricted", 2026, 1),
    (5, "Corrupted_scan.pdf", "PDF", 2048, "Failed", "Internal", 2026, 2),
    (6, "Universal Service Fund Annual Report.pdf", "PDF", 3260, "Ready", "Public", 2025, 3),
]
ADMIN = Caller(9, "Administrator")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, None) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Amani Otieno"), (2, "Wanjiru Kamau"), (3, "Amara Hassan")], "id long, full_name string")


@pytest.mark.parametrize(("params", "ids"), [
    ({}, {1, 2, 3, 4, 5, 6}), ({"q": "corrupted"}, {5}), ({"q": "d_s"}, {5}), ({"q": "0"}, {1, 2, 3, 4, 5, 6}), ({"status": "Ready"}, {1, 3, 6}), ({"status": "Failed, Processing"}, {4, 5}),
    ({"classification": "Public"}, {3, 6}), ({"year": 2025}, {6}), ({"author": "Amani"}, {1, 3, 4}), ({"status": "Ready", "classification": "Public", "year": 2026}, {3}),
])
def test_filters(docs, users, params, ids):
    assert {r.id for r in listing.filtered(docs, ADMIN, params, users).collect()} == ids


def test_pages(docs):
    found = listing.page(docs, {"per_page": 2, "page": 2, "sort": "name", "direction": "asc"}).collect()
    assert [r.id for r in found] == [1, 4]
    assert listing.page_meta(docs, {"per_page": 4}).first() == (6, 2)
    assert listing.page_meta(docs.where("false"), {}).first() == (0, 1)


def test_dashboard(docs):
    assert listing.dashboard(docs, ADMIN).first() == (6, 3, 1, 1, 1)
    assert listing.dashboard(docs.where("false"), ADMIN).first() == (0, 0, 0, 0, 0)
    assert listing.dashboard(docs, Caller(9, "Owner")).first() == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("params", [{"status": "Gone"}, {"year": 1999}, {"per_page": 101}, {"per_page": 0}, {"sort": "secret"}, {"q": "x" * 256}])
def test_bad_parameters(params):
    with pytest.raises(ValueError, match=":"):
        rules.listing_parameters(params)


def test_rules():
    assert rules.comma_list(" a, ,0,b") == ["a", "b"]
    assert rules.clamped_page_size("500") == 100 and rules.clamped_page_size(None) == 20
    assert rules.may_upload("Personal", "Viewer") and not rules.may_upload("Organization", "Analyst")
    assert rules.type_for_extension(".DOCX") == "DOCX" and rules.type_for_extension("csv") is None
    with pytest.raises(ValueError, match="limit"):
        rules.search_parameters("ab", 51)


def test_row_security_refuses_two_credentials(spark):
    view = spark.createDataFrame([(1, "a"), (2, None)], "id int, workspace_id string")
    two = spark.createDataFrame([("r", "a", None), ("r", "b", None)], "db_role string, workspace_id string, revoked_at string")
    with pytest.raises(Exception, match="(?i)scalar"):
        access.secured(view, two, "r").collect()
    assert [r.id for r in access.secured(view, two.limit(1), "r").collect()] == [1]


@pytest.mark.parametrize(("paragraphs", "sizes"), [([], []), ([3000], [3000]), ([600, 600], [1202]), ([600, 601], [600, 601]), ([1200] * 250, [1200] * 200), ([10, 3000, 10], [10, 3000, 10])])
def test_chunks(spark, paragraphs, sizes):
    whole = "\n \t\n".join("x" * n for n in paragraphs)
    df = spark.createDataFrame([(1, whole)], "id int, extracted_text string")
    assert [len(r.chunk_text) for r in text.chunks(df).orderBy("chunk_index").collect()] == sizes


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.0, 0.0])], "id int, embedding array<float>")
    assert [(r.id, r.similarity) for r in vectors.top_k(df, [2.0, 0.0], 4).collect()] == [(1, 1.0), (4, -1.0), (2, None), (3, None)]


def test_first_copies_treat_no_workspace_as_one(spark):
    df = spark.createDataFrame([(1, None, "h", None), (2, None, "h", None), (3, "a", "h", None)], "id int, workspace_id string, file_hash string, created_at timestamp_ntz")
    assert {(r.id, r.copies) for r in load.first_copies(df).collect()} == {(1, 2), (3, 1)}


def test_rendered_values_are_not_searched(spark):
    df = spark.createDataFrame([("{{b}}", "x")], "a string, b string")
    assert df.select(text.rendered("{{a}}-{{b}}", {"a": F.col("b"), "b": F.col("b")})["text"]).first()[0] == "x-x"
    assert df.select(text.rendered("{{a}}", {"a": F.col("a")})["error"]).first()[0] == "unresolved placeholder"


def test_enabled_lists():
    assert rules.enabled_extensions() == ["pdf", "docx", "xlsx"] and len(rules.enabled_mime_types()) == 3
    assert rules.enabled_mime_types()[0] == "application/pdf" and [rules.type_for_extension(x) for x in (".PDF", "csv", None, "docx")] == ["PDF", None, None, "DOCX"]


def test_natural_order(spark):
    from paperloom.functions.columns import natural_key

    names = ["a1", "a2b1", "a2b10", "a10", "a010b", "a99999999999999999999999", "b", "b0", "b00", "b1", ""]
    rows = spark.createDataFrame([(x,) for x in reversed(names)], "name string").orderBy(natural_key(F.col("name")), "name")
    assert [r.name for r in rows.collect()] == ["", "a1", "a2b1", "a2b10", "a10", "a010b", "a99999999999999999999999", "b", "b0", "b00", "b1"]


def test_long_recogniser_table(spark):
    """Words beyond the millionth line count."""
    from paperloom.operators.text import words_of_tsv

    line = F.lit("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t-1\tx\n")
    last = F.lit("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\tlast")
    got = spark.range(1).select(words_of_tsv(F.concat(F.lit("head\n"), F.repeat(line, F.lit(1_000_100)), last)).alias("w")).first().w
    assert [(w.position, w.word) for w in got] == [(1_000_100, "last")]
