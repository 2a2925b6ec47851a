import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#[|é漢\r", max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_counts(texts):
    counts = Q._counts(pa.array(texts, pa.string()))
    got = list(zip(*(counts[k].tolist() for k in Q.BASE)))
    assert got == [brute(t) for t in texts]


def test_odd_rows(spark, odd, no_documents, some_labels):
    forest = Q.learn(odd, some_labels)
    rows = Q.judge(odd, forest).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0 and by_id[2].base_failed
    assert by_id[5].n_words == 20_000 and by_id[5].base_failed
    assert Q.judge(no_documents, Q.learn(no_documents, some_labels)).count() == 0
    assert Q.learn(odd, some_labels.limit(0)).trees == []
    kept = Q.judge(odd, forest, tuple(odd.columns)[:8])
    assert kept.columns[:8] == odd.columns[:8]


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    usual = np.clip(rng.normal(0.1, 0.01, (400, 9)), 0, None)
    odd_rows = np.clip(rng.normal(0.1, 0.01, (20, 9)), 0, None)
    odd_rows[:, :3] += rng.uniform(1, 2, (20, 3))
    every = np.concatenate([usual, odd_rows])
    forest = Q.Forest.grow(every)
    good = np.arange(420) < 400
    forest.calibrate(forest.score(every), good, 0.01)
    assert (forest.score(odd_rows) > forest.threshold).all()
    assert (forest.score(usual) <= forest.threshold).mean() >= 0.99


def plain_score(forest, row):
    """Path by path, as the method's paper has it."""
    total = 0.0
    for column, cut, leaf in forest.trees:
        node = 0
        while column[node] >= 0:
            node = 2 * node + (2 if row[column[node]] >= cut[node] else 1)
        total += leaf[node]
    n = forest.sample
    expected = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return 2 ** (-total / len(forest.trees) / expected)


def test_forest_is_the_plain_one():
    rng = np.random.default_rng(1)
    rows = rng.random((300, 4)) * [1, 1, 0, 5]
    forest = Q.Forest.grow(rows, 30, 64)
    assert np.allclose(forest.score(rows[:40]), [plain_score(forest, r) for r in rows[:40]])
    for column, _, _ in forest.trees:
        assert 2 not in column  # without spread there is nothing to split


def test_good_rows_stay_and_bad_rows_go(sample, sample_labels):
    forest = Q.learn(sample, sample_labels)
    joined = Q.judge(sample, forest).join(sample_labels, "doc_id").where("not base_failed").toPandas()
    assert joined.loc[joined.quality == 1, "kept"].mean() > 0.97
    assert (~joined.loc[joined.quality == 0, "kept"]).mean() > 0.8
    assert joined["anomaly"].round(6).nunique() > 20  # rows spread over the leaves
    forest.trees = forest.trees[:1]  # one tree alone judges otherwise: it is the forest that decides
    fewer = Q.judge(sample, forest).join(sample_labels, "doc_id").where("not base_failed").toPandas()
    assert (fewer.sort_values("doc_id")["kept"].to_numpy() != joined.sort_values("doc_id")["kept"].to_numpy()).any()


def test_every_labelled_row_sets_the_threshold(spark):
    """9000 labelled rows, more than were once looked at: as on arrays, and each row counts."""
    rng = np.random.default_rng(3)
    good = rng.random(9000) < 0.9
    scores = np.where(good, rng.normal(0.4, 0.05, 9000), rng.normal(0.6, 0.1, 9000))
    table = spark.createDataFrame([(bool(g), float(s)) for g, s in zip(good, scores)], "good boolean, score double")
    plain = Q.Forest()
    plain.calibrate(scores, good, 0.002)
    assert Q.Forest().calibrate_on(table, 0.002).threshold == plain.threshold
    more = table.union(spark.createDataFrame([(True, 5.0)] * 40, table.schema))
    assert Q.Forest().calibrate_on(more, 0.002).threshold >= 5.0


def test_learning_takes_all_labelled_rows(spark, monkeypatch):
    """Every labelled document reaches the calibration."""
    seen = []
    monkeypatch.setattr(Q.Forest, "calibrate_on", lambda self, scores, lost: seen.append(scores.count()) or self)
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.range(6500).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + " "), F.col("id").cast("string")).alias("text"))
    Q.learn(docs, docs.selectExpr("doc_id", "1 as quality"), n_trees=2)
    assert seen == [6500]
