from tidyfold.llm import toxicity

DOCS = [(i, f"{'vile awful' if i % 2 else 'kind gentle'} words number {i}") for i in range(40)]


def frames(spark, labels):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, doc string")


def test_without_labels_or_with_one_class_there_is_no_network(spark):
    for labels, share in (([], 0.0), ([(1, 1, "x")], 1.0), ([(None, 1, "x"), (2, 0, "x")], 0.0)):
        docs, table = frames(spark, labels)
        net, found = toxicity.train(docs, table)
        assert net is None and found == share
        assert {r.score for r in toxicity.score_texts(docs, net, found).collect()} == {share}


def test_an_id_labelled_twice_counts_with_each_label(spark):
    docs, table = frames(spark, [(i, i % 2, "x") for i in range(40)] + [(0, 1, "y"), (1, 1, "y")])
    net, share = toxicity.train(docs, table)
    assert net is not None and share == 22 / 42
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(docs, net, share).collect())
