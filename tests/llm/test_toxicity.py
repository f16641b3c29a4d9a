import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brisa.llm import toxicity
from tests.llm.conftest import prose

INSULTS = ["dumbhead", "nitwit", "foolzer", "grublin"]


def labelled(count=240, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(count):
        words = prose(seed * 1000 + i, 60, "abcdefghilmnorstu").split()
        toxic = int(i % 3 == 0)
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((" ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.train(labelled())


def rate(model, texts):
    words, codes, owner = toxicity.words_of(pa.array(texts))
    worst = [toxicity.MILDEST] * len(texts)
    for s, o in zip((toxicity.scores(words, model.weights) + model.offset)[codes], owner):
        worst[o] = max(worst[o], s)
    return [float(model.curve(w)) for w in worst]


def test_held_out_accuracy(model):
    rows = labelled(seed=5)
    right = sum((p >= 0.5) == bool(y) for p, (_, y) in zip(rate(model, [t for t, _ in rows]), rows))
    assert right >= 0.95 * len(rows)


@pytest.mark.parametrize("insult", ["nitwit", "nit-wit", "n i t w i t", "NITWIT!!", "nitxwit", "dumbbhead", "grubblin"])
def test_gaps_and_inserted_characters(model, insult):
    clean = prose(77, 40, "abcdefghilmnorstu")
    assert rate(model, [f"{clean} {insult} {clean}"])[0] >= 0.5 > rate(model, [clean])[0]


def test_odd_rows(model, odd, given):
    scored = odd.select("doc_id", "text", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(scored) == len(given) and all(0 <= r["s"] <= 1 for r in scored)
    assert len({r["s"] for r in scored if not (r["text"] or "").strip()}) == 1


def test_long_words_are_read_whole(model):
    plain = "e" * 300
    assert rate(model, [plain + " nitwit"])[0] >= 0.5
    words = [plain, plain[:150] + "nitwit" + plain[150:]]
    a, b = toxicity.scores(words, model.weights)
    assert b > a


def test_without_labels_of_both_kinds(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    for docs, known in ((odd, labels), (none, labels), (odd, labels.where("false"))):
        model = toxicity.fit(docs, known, "toxic", F.lit(True))
        assert {r[0] for r in docs.select(toxicity.score(F.col("text"), model)).collect()} <= {0.0}


def test_fit_is_the_same_again(spark, frame):
    rows = labelled(60)
    docs = frame([(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    one, two = (toxicity.fit(d, labels, "toxic", F.expr("doc_id % 5 <> 0")) for d in (docs, docs.repartition(7)))
    assert (one.weights == two.weights).all() and one.landmarks == two.landmarks
