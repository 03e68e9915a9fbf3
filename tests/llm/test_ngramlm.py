import math
import random
import re
from collections import Counter

import pytest

from tallyworks.llm import ngramlm

SCHEMA = "doc_id long, text string, part long, n int"


def brute(rows, order=3, alpha=0.4, least=2):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[i:i + n]) for w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))

    def s(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= least else alpha * s(gram[1:])

    return sorted(((i, len(w), round(sum(math.log(s(tuple(w[max(0, k - order + 1):k + 1]))) for k in range(len(w))), 6)) for (i, _), w in zip(rows, docs, strict=True)), key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_same_as_brute_force(spark, order):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice("abcdeé") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    rows += [(None, "a b c"), (7, None), (8, "  \n\t "), (9, "once"), (9, "once"), (10, "long " * 40000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)
    got = ngramlm.score(df, order).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=str) == brute(rows, order)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    joined = ngramlm.score_joined(df, order).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in joined), key=str) == brute(rows, order)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngramlm.score(none).count() == 0 and ngramlm.score_joined(none).count() == 0
