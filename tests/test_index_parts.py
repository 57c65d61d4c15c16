"""A state of the index holds its terms; a query makes the parts that it reads, and no others."""

from lodestone.operators import search
from lodestone.sources.kept import listed
from lodestone.sources.tables import sections


def test_parts_are_made_when_asked_for(spark, tmp_path):
    index = search.Index.build(sections(spark, "/root/testdata/sf0.001"), f"{tmp_path}/index")
    parts = lambda: {x for x in listed(spark, index.postings.state) if not x.startswith(".")} - {"terms", "segments", "done"}
    assert index.idf.count() > 0 and index.postings.weights().count() > 0
    assert parts() == set()
    assert index.keyword("the erth", []).count() > 0
    assert parts() == {"keywords", "keyword-grams"}
    again = search.Index.open(spark, f"{tmp_path}/index")
    assert again.semantic("onblereon moron").count() >= 0
    assert parts() == {"keywords", "keyword-grams", "prefixes", "term-grams", "weighed", "blocks"}


def test_a_bucket_is_one_row_for_each_term(spark, tmp_path):
    index = search.Index.build(sections(spark, "/root/testdata/sf0.001"), f"{tmp_path}/index").postings
    raw = index._segments("counts", index.segments)
    assert raw.count() == raw.select("bucket", "term").distinct().count() < index.weights().count()
