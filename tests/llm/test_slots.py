"""Benchmark items whose windows hold few plain words, or that start inside a sentence of a document."""

from logloom.llm import decontaminate


def test_slot_dense_and_short_items_are_found(spark):
    items = [(1, "What is 12 * 7?"), (2, "Compute 12 + 7 - 3 * 4 / 2 + 9"), (3, "Every farmer sells 3 cows"), (4, "12 7 9"), (5, "Add 5 6 7 8 9 1 2 3 4 to 5 6 7 8 9 1 2 3 4 now")]
    docs = [
        (1, "He asked, What is 12 * 7? and left."),
        (2, "The task Compute 12 + 7 - 3 * 4 / 2 + 9 came next"),
        (3, "The task: Compute 5 + 3 - 8 * 2 / 1 + 4 came next"),
        (4, "They say that, Every farmer sells 5 cows in may"),
        (5, "the code was 12 7 9 then"),
        (6, "the code was 12 7 8 then"),
        (7, "Then Add 4 6 7 8 9 1 2 3 5 to 4 6 7 8 9 1 2 3 5 now"),
        (8, "nothing of the kind is in here at all"),
    ]
    spark_docs, spark_items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(spark_docs, spark_items).collect()}
    assert got == {(1, 1, False), (2, 2, False), (3, 2, True), (4, 3, True), (5, 4, False), (7, 5, True)}
