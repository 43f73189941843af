"""Stateless scoring of a streaming DataFrame equals batch scoring."""

import numpy as np
import pandas as pd

from rugosa.operators import kernels as kk
from rugosa.operators import preprocess as pp
from rugosa.streaming import score_stream


def test_stream_scoring_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 150
    pdf = pd.DataFrame({"run_id": [f"s{i}" for i in range(n)], "Vc": rng.uniform(5, 20, n),
                        "Fz": rng.uniform(0.04, 0.16, n), "ap": rng.uniform(0.7, 1.6, n)})
    pdf["y"] = 0.2 + 0.02 * pdf.Vc + 3 * pdf.Fz * pdf.ap
    pdf["fold"] = (np.arange(n) % 5).astype("int32")
    df = spark.createDataFrame(pdf)
    summary = pp.input_summary(df, "y")
    prep = pp.fit_prep(summary, 1)
    gp = kk.fit_gp(summary, prep, [kk.GPSpec()], n_features=64, states=[5])
    src = str(tmp_path / "incoming")
    df.select("run_id", "Vc", "Fz", "ap").write.parquet(src)
    stream = spark.readStream.schema("run_id string, Vc double, Fz double, ap double").parquet(src)
    q = score_stream(stream, None, gp).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored").toPandas().sort_values("run_id").reset_index(drop=True)
    ref = kk.score_inputs(df, None, gp).toPandas().sort_values("run_id").reset_index(drop=True)
    assert len(got) == n and np.allclose(got.pred_gpr, ref.pred_gpr) and np.allclose(got.std_gpr, ref.std_gpr)
