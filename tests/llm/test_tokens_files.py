from semblance.llm import tokens


def test_shard_files_are_read_by_slices(spark, tmp_path):
    texts = [" ".join(f"word{(i * 7 + k * k) % 97} and{k % 11}" for k in range(5 + i % 60)) for i in range(300)] + [None, ""]
    rows = tokens.binary(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_bytes=2000)
    index = tokens.write_shards(spark, rows, str(tmp_path / "ids")).collect()
    assert sorted(r.doc_id for r in index) == list(range(302)) and len({r.file for r in index}) > 4
    heads = {r.file: tokens.read_head(str(tmp_path / "ids"), r.file) for r in index}
    for r in index:
        frame = tokens.read_frame(str(tmp_path / "ids"), r.file, r.offset, r.length)
        assert tokens.text_of(frame, heads[r.file] if r.dict_hash else None) == (texts[r.doc_id] or "")
