from semblance.llm import tokens


def test_copies_do_not_fill_the_dictionary(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 97} and{k % 11}" for k in range(60))) for i in range(200)]
    copies = [(1000 + i, rows[3][1]) for i in range(500)]
    one, many = (tokens.dictionary(spark.createDataFrame(x, "doc_id long, text string")) for x in (rows, rows + copies))
    assert one and one == many
