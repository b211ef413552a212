"""Words that only bad rows hold."""

from logloom.llm import quality


def test_words_of_one_class_count(spark):
    rows = [(i, "plain words here" + (" trash" if i < 15 else ""), int(i >= 50)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    of_words = quality.train(docs, labels)[0]
    bucket = lambda w: quality.features(w)[0][0]
    assert of_words[bucket(b"trash")] < -3 and of_words[bucket(b"plain")] == 0
