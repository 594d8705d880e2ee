from corpusweave.operators.encode import encode, texts
from corpusweave.params import Specials
from corpusweave.streaming import append_rows, clean_chat, truncated_arrivals

SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)


def test_arrivals_equal_the_batch_result(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocab = spark.createDataFrame([("the", 4), ("and", 5)], "token STRING, id INT")
    for part in docs.randomSplit([0.5, 0.5], seed=1):
        part.write.mode("append").parquet(source)
        arriving = spark.readStream.schema(docs.schema).parquet(source)
        rows = truncated_arrivals(arriving, vocab, SPECIALS, 16)
        append_rows(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.doc_id: r.input_ids for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: r.input_ids[:16] for r in encode(texts(docs), vocab, SPECIALS, ["doc_id"]).collect()}
    assert got == want


def test_chat_cleaning_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "Assistant: hello"), (2, "> - quoted")], "conv_id LONG, text STRING")
    rows.write.parquet(source)
    cleaned = clean_chat(spark.readStream.schema(rows.schema).parquet(source))
    append_rows(cleaned, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.conv_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "hello", 2: "quoted"}
