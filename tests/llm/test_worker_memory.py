import os
import subprocess
import sys

import numpy as np
import pytest

from cirro.llm import langid

PIECES = ["▁", "a", "b", "c", "d", "e", "f", "ab", "cd"]

#: One worker, so that the later job runs where the texts were scored; 8000 texts of 200 words of 4 to 23 letters, half of which few texts have.
SCRIPT = """
import numpy as np, pandas as pd, re
from pyspark.sql import SparkSession
from cirro.llm import langid

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
pieces = list("▁abcdefghijklmnop")
prob = np.vstack([np.random.default_rng(0).random((len(pieces) + 1, 3)) / 10, np.zeros((1, 3))])
letters = "translate(concat(hex(xxhash64(i, if(i % 2 = 0, id, id % 50))), hex(xxhash64(id))), '0123456789', 'ghijklmnop')"
docs = spark.range(0, 8000, 1, 1).selectExpr("id as doc_id", f"array_join(transform(sequence(0, 199), i -> substr({letters}, 1, 4 + cast(pmod(xxhash64(id, i, 1), 20) as int))), ' ') as text")
assert langid.predict(docs, langid.Model(["a", "b"], langid.Pieces(pieces), prob)).where("score >= 0").count() == 8000

def held(batches):
    for _ in batches:
        yield pd.DataFrame({"kb": [sum(map(int, re.findall(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))]})

print("MB", spark.range(0, 1, 1, 1).mapInPandas(held, "kb long").first()[0] // 1024)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="no such figures here")
def test_a_waiting_worker_does_not_hold_the_words_of_its_last_task():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("MB")[1]) < 100


def test_a_full_cache_keeps_the_words_of_the_texts_at_hand(monkeypatch):
    prob = np.vstack([np.random.default_rng(1).random((len(PIECES) + 1, 3)), np.zeros((1, 3))])
    model = langid.Model(["a", "b"], langid.Pieces(PIECES), prob)
    texts = [["aa bb cc", None], ["aa dd"], ["aa aa ee", "dd ff"]]
    want = [langid.Scorer(model).batch(t) for t in texts]
    learnt, own = [], model.log_likelihood
    monkeypatch.setattr(model, "log_likelihood", lambda units: learnt.append(sorted(units)) or own(units))
    scorer = langid.Scorer(model, cache_size=4)
    assert [scorer.batch(t) for t in texts] == want
    assert [x for x in learnt if x] == [["▁aa", "▁bb", "▁cc"], ["▁dd"], ["▁ee", "▁ff"]]
    assert len(scorer.cache) == 4
