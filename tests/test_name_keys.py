"""Names are keyed over whole texts, not over their beginnings."""

from blockloom.plans import registry


def test_every_phrase_of_a_text_is_keyed(spark, tmp_path):
    late = "x" * 70 + ". São Paulo|“Zürich”\nnone.L’Aquila, CafÃ© " + "y" * 5_000 + " Łódź"
    spark.createDataFrame([(1, late), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["city_name_keys"](spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.phrase): (r.name_key, r.token, r.join_key) for r in rows}
    assert len(got) == len(rows) == 7
    assert got[1, 0] == ("x" * 70,) * 3
    assert got[1, 1] == ("saopaulo", "Sao_Paulo", "saopaulo")
    assert got[1, 2] == ("zurich", "Zurich", "zurich")
    assert got[1, 3] == ("", "", "none")
    assert got[1, 4][0].startswith("laquila") and got[1, 4][0].endswith("y" * 5_000 + "odz")
    assert got[2, 0] == got[3, 0] == ("", "", "")
