"""The check's findings on memory: op13_pieces held two workers a task, and a worker that only decodes the encoder's tables."""

from pyspark.sql import functions as F

from fuseline.llm import pieces, queries


def test_op13_has_one_worker_a_task(spark, tmp_path):
    texts = ["Some words, and more words.", None, "", " é漢\n\x00 ", "<s> </s>", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op13_pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython (") <= 1
    ids = pieces.encode_pieces(F.col("text"), end_id=True)
    apart = df.select("doc_id", ids.alias("ids")).select("doc_id", "ids", pieces.decode_pieces(F.col("ids")).alias("decoded"))
    once = df.select("doc_id", pieces.encode_and_decode(F.col("text"), end_id=True).alias("b")).select("doc_id", "b.ids", "b.decoded")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, apart.collect()))


def test_decoding_builds_no_encoder():
    model = pieces.PieceModel(pieces.path_of(pieces.MODEL))
    model.decode([5, 300, 2])
    assert not {"automaton", "segments"} & vars(model).keys()
    model.encode("a b")
    assert {"automaton", "segments"} <= vars(model).keys()
