"""Benchmark of the headline jobs; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each step forces full execution with the ``noop`` sink (no collect), so the
time is the Spark job itself: P3 dedup, the cleaned table written once (the
input of every later step), P19 feature matrix, the flagship
(dedup -> score -> best per pair -> top-N), training of the serving models,
M10 batch scoring of every recipe row, the monomer screen (J2 + M10 + A1)
and path attribution over every row and tree (M16).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from permea.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    from pyspark.sql import functions as F

    from permea.operators import clean as C
    from permea.operators import features as FE
    from permea.operators import models as MD
    from permea.operators import splits as SP
    from permea.plans import explain as XP
    from permea.plans import flagship as FL
    from permea.plans import scoring as SC
    from permea.plans import training as TRN
    from permea.sources import fixture as FX

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    from permea.session import materialize
    raw = FX.recipes(spark, sf_dir)
    timed("p3_dedup", lambda: run(C.dedup_first(C.with_synth_key(raw))))
    clean = timed("clean_table_write", lambda: materialize(C.clean_recipes(raw), "clean"))

    def features():
        cats = FE.membrane_categories(clean)
        run(FE.build_features(clean, cats, keep=SP.ROW_KEY_COLS))
    timed("p19_feature_matrix", features)
    timed("flagship_best_pairs", lambda: run(FL.best_measured_pairs(raw, 15)))
    res = timed("train_serving_models",
                lambda: TRN.quick_models(clean, MD.FAST, stage1=True, intervals=False))
    timed("m10_batch_score", lambda: run(SC.score_batch(clean, res, intervals=False)))
    timed("j2_screen_monomers", lambda: run(SC.screen_monomers(clean, res)["best"]))

    def shap():
        d = TRN.target_frame(res.features, "Mg_rej")
        m = res.models["Mg_rej"].fitted[0]
        long, check, _ = XP.path_shap(d, m, SP.ROW_KEY_COLS)
        run(long.groupBy("feature").agg(F.avg(F.abs("phi"))))
    timed("m16_path_shap", shap)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
