import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_rows import EDGES, frame
from rainledger.llm import insult_svm, quality_mil
from rainledger.llm.registry import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def graded(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {}
    for name, column in (("op2_quality_mil", "quality"), ("op8_insult_svm", "toxic")):
        rows = QUERIES[name](spark, SF).cache()
        assert rows.count() == 10000 and rows.where("score < 0 OR score > 1 OR isnan(score) OR score IS NULL").isEmpty()
        out[column] = rows.join(labels, "doc_id").where("held_out").select("predicted", F.col(column).alias("label")).toPandas()
    return out


@pytest.mark.parametrize(("column", "recall", "false_alarms"), [("quality", 0.99, 0.1), ("toxic", 0.85, 0.02)])
def test_held_out(graded, column, recall, false_alarms):
    d = graded[column]
    assert d.predicted[d.label == 1].mean() >= recall
    assert d.predicted[d.label == 0].mean() <= false_alarms


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module", [quality_mil, insult_svm])
def test_edges(spark, edges, empty, module):
    few = labels_frame(spark, [(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None)])
    for model in (b"", module.train(edges, few), module.train(edges, few.limit(0)), module.train(edges, labels_frame(spark, [(4, 1, 1)]))):
        rows = module.score(edges, model).collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(empty, model).collect() == []
    assert module.train(empty, few) == b""


def test_only_the_learning_rows_are_read(spark):
    draw = np.random.RandomState(0)
    texts = [(i, " ".join(("bad!!" if i % 2 else "good") for _ in range(draw.randint(5, 90)))) for i in range(300)]
    docs = frame(spark, texts)
    labels = labels_frame(spark, [(i, 1 - i % 2, i % 2) for i in range(300)])
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_mil.train(docs, labels) == quality_mil.train(docs, turned)


def test_gradients():
    draw = np.random.RandomState(3)
    model = quality_mil.AttentionModel.new()
    x, firsts, y = draw.normal(size=(7, quality_mil.INPUTS)) / 5, np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, firsts)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, grad in model.gradients(x, firsts, y, 0.0).items():
        part = model.parts[name]
        for at in [tuple(draw.randint(0, n) for n in part.shape) for _ in range(5)]:
            kept = part[at]
            part[at] = kept + 1e-5
            up = loss()
            part[at] = kept - 1e-5
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_collapsed_weights_equal_the_kernel_sum():
    given = [b"idiot", b"loser", b"there", b"which", b"clown"]
    marks = insult_svm._Landmarks(given)
    kernel = marks.kernel(given)
    assert np.allclose(kernel, kernel.T) and np.linalg.eigvalsh(kernel).min() > -1e-6
    w = np.random.RandomState(1).normal(size=marks.map.shape[1])
    model = insult_svm.KernelModel(marks.collapse(w), 0.25, np.zeros(insult_svm.FEATURES + 1))
    probe = [b"idiotic", b"lloser", b"xyz", b"these"]
    assert np.allclose(model.of_units(probe), marks.kernel(probe) @ marks.map @ w + 0.25)


def test_gaps_and_inserts():
    marks = insult_svm._Landmarks([b"idiot"])
    for word in (b"id-iot", b"i.d.i.o.t", b"idi_ot"):
        assert insult_svm.units(word) == [b"idiot"]
    assert b"idiot" in insult_svm.words(b"you i d i o t there")
    near, far = marks.kernel([b"idxiot"])[0, 0], marks.kernel([b"thereon"])[0, 0]
    assert near > 0.3 > far
