"""Five folds within the training rows of the toxicity model, for L1 and L2: the held-out fold of the query is never read.

Run as `python -m tests.llm.cross_validation [sf_dir]`; prints the mean log loss and what threshold 0.5 finds, by choice.
"""

import sys
import time

import numpy as np

from pagelake.llm import toxicity

CHOICES = ((5e-5, 0), (1e-4, 0), (2e-4, 0), (4e-4, 0), (8e-4, 0), (2e-4, 1e-4), (2e-4, 1e-3), (2e-4, 3e-3), (4e-4, 1e-3))


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").filter(~toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").select("doc_id", "text", "toxic").collect()
    texts, y = [(r.text or "").encode() for r in known], np.array([r.toxic for r in known])
    rows, swapped = [toxicity.features_of(t) for t in texts], [toxicity.swapped_features(t) for t in texts]
    fold = np.random.default_rng(5).permutation(len(rows)) % 5
    bases = [np.unique(toxicity.raw_features(t)) for t in texts]
    print(len(y), "rows", y.sum(), "toxic")
    for l1, l2 in CHOICES:
        scores, began = np.zeros(len(rows)), time.time()
        for k in range(5):
            train = np.flatnonzero(fold != k)
            model = toxicity.fit_rows([rows[i] for i in train], y[train], np.ones(len(train)), np.unique(np.concatenate([bases[i] for i in train])), [swapped[i] for i in train], l1, l2)
            for i in np.flatnonzero(fold == k):
                scores[i] = model.score(texts[i])
        p = np.clip(scores, 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        found, alarms = int(((scores >= 0.5) & (y == 1)).sum()), int(((scores >= 0.5) & (y == 0)).sum())
        print(f"L1 {l1}, L2 {l2}: log loss {loss:.4f}, toxic found {found} of {y.sum()}, false alarms {alarms} of {(1 - y).sum()}, {time.time() - began:.0f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
