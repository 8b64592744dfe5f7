from semblance.llm import decontaminate


def test_items_without_an_id_match_by_broadcast_and_by_shuffle(spark):
    docs = spark.createDataFrame([(1, "so a b c d e f g it is"), (2, "nothing of it in here at all"), (3, "h i j k l m n"), (4, "o p q r s t u"), (4, "o p q r s t u")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f g"), (None, "h i j k l m n"), (7, "o p q r s t u"), (7, "nowhere to be found in any of these")], "item_id long, text string")
    for limit in (1 << 20, 0):  # by broadcast, and by shuffle
        got = sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(spark, docs, bench, broadcast_bytes=limit).collect())
        assert got == [(1, None, 1.0), (3, None, 1.0), (4, 7, 1.0), (4, 7, 1.0)]
        assert [r.doc_id for r in decontaminate.clean(spark, docs, bench, broadcast_bytes=limit).collect()] == [2]
