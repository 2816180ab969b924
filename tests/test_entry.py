"""What the driver asks for."""

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert "winner_name" in entry.entry(spark).columns


def test_contacts_of_all_platforms(spark, tmp_path):
    texts = [(1, "see fb.com/asha.k and x.com/asha_k"), (2, "A@B.example"), (3, "nothing"), (4, None), (5, "youtu.be/abcdef, instagram.com/asha.k")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in entry.queries()["n29_contacts"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 5} and list(got[1]) == ["doc_id", "facebook", "instagram", "x", "youtube", "email"]
    assert got[1]["facebook"] == "fb.com/asha.k" and got[1]["x"] == "x.com/asha_k" and got[1]["email"] is None
    assert got[2]["email"] == "a@b.example" and got[5]["youtube"] == "youtu.be/abcdef" and got[5]["instagram"] == "instagram.com/asha.k"


def test_whole_listing_has_every_row(spark):
    folder = "/root/testdata/sf0.001"
    got = [tuple(r) for r in entry.queries()["w8_whole_listing"](spark, folder).collect()]
    first = [tuple(r) for r in entry.queries()["w8_listing"](spark, folder).collect()]
    assert len(got) == spark.read.parquet(f"{folder}/customer.parquet").count() > len(first) and got[: len(first)] == first
