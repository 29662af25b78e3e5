import random

import numpy as np
import zstandard
from brute_llm import HARD, hard_docs
from pyspark.sql import functions as F

from flowlake.llm import compression_quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = Q.query(spark, SF).join(truth, "doc_id").filter("held_out").toPandas()
    assert len(found) > 900 and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    assert (found.predicted == found.quality).mean() >= 0.98
    assert found[found.quality == 1].predicted.mean() >= 0.985 and found[found.quality == 0].predicted.mean() <= 0.08
    assert ((found.score - found.quality) ** 2).mean() <= 0.02  # calibrated: no better by pulling scores to the middle
    assert abs(found.score.mean() - found.quality.mean()) <= 0.01


def brute_score(text, model):
    """Sizes of the segments by the library's one-call interface."""
    raw = (text or "").encode()
    saved = 0
    for at in range(0, len(raw), Q.SEGMENT):
        sizes = [len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False,
                                              write_dict_id=False).compress(raw[at:at + Q.SEGMENT])) for d in (model.bad, model.good)]
        saved += sizes[0] - sizes[1]
    difference = (saved + Q.DAMPING * model.mean) / (len(raw) + Q.DAMPING)
    return 1 / (1 + np.exp(-(model.slope * difference + model.intercept)))


def labelled(spark, rows):
    return (spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string"),
            spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, quality int"))


def trained(spark):
    random.seed(2)
    words = ["river", "stone", "market", "green", "house", "winter", "letter", "garden", "music", "bridge"]
    rows = [(" ".join(random.choice(words) for _ in range(random.randint(20, 300))), 1) for _ in range(120)]
    rows += [(" ".join(random.choice(["BUY!!", "$$$", "now###", "CLICK!!", "free%%%"]) for _ in range(random.randint(20, 300))), 0) for _ in range(120)]
    rows += [(None, 1), ("", 0), ("unlabelled", None), ("other", 7)]
    docs, labels = labelled(spark, rows)
    even = F.col("doc_id") % 2 == 0
    return rows, Q.fit(docs, labels.filter(even), labels.filter(~even))


def test_scores_against_the_definition(spark):
    rows, model = trained(spark)
    docs = hard_docs(spark).withColumns({"_score": F.lit("mine"), "saved": F.lit(1)})
    found = Q.score(docs, model).collect()
    assert len(found) == len(HARD) and {r.node for r in found} == {"node"} and {r.saved for r in found} == {1}
    assert sorted((repr(r.text), round(r._score, 9)) for r in found) == sorted((repr(t), round(brute_score(t, model), 9)) for _, t, _ in HARD)
    judged = Q.score(labelled(spark, rows)[0], model).collect()
    assert all((r._score >= 0.7) == (rows[r.doc_id][1] == 1) for r in judged if rows[r.doc_id][1] in (0, 1) and len(rows[r.doc_id][0] or "") > 50)
    assert Q.score(hard_docs(spark, []), model).count() == 0


def test_nothing_or_one_label_to_learn_from(spark):
    docs, labels = labelled(spark, [("good words " * 30, 1)] * 6)
    none = labels.filter("false")
    assert {r._score for r in Q.score(docs, Q.fit(docs, none, none)).collect()} == {0.5}
    one = Q.fit(docs, labels, labels)
    assert one.bad == b"" and one.good and all(0 <= r._score <= 1 for r in Q.score(docs, one).collect())


def test_curve_is_the_least_loss():
    rng = np.random.default_rng(6)
    values, labels, counts = rng.normal(size=60), (rng.random(60) < 0.6).astype(float), rng.integers(1, 9, 60).astype(float)
    slope, intercept = Q.curve(values, labels, counts)
    positive, total = counts[labels == 1].sum(), counts.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (total - positive + 2))

    def loss(a, b):
        return (counts * (np.logaddexp(0, a * values + b) - target * (a * values + b))).sum()

    assert all(loss(slope, intercept) <= loss(slope + x, intercept + y) + 1e-9 for x in (-.1, 0, .1) for y in (-.1, 0, .1))
    apart = Q.curve(np.array([-1.0, 1.0]), np.array([0.0, 1.0]), np.array([500.0, 500.0]))
    assert np.isfinite(apart).all() and apart[0] > 3
