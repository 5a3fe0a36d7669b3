"""Score -> label (RL) with noise and exact-count label flips.

* normalise: (s - min) / (max - min + 1e-9), min/max from one global aggregate;
* noise: sd * (sum of 12 key-derived uniforms - 6) (Irwin-Hall, mean 0, sd 1);
  the uniforms are dyadic so the sum is exact and engine independent;
* threshold: exact linear-interpolation quantile at 1 - target rate;
* flips: floor(0.12 * #pos) positives -> 0 and floor(0.005 * #neg) negatives -> 1,
  both chosen from the pre-flip labels as the first k rows by a 60-bit draw
  (Donation_ID breaks ties) -- found with distributed selection, not by sorting
  a label group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.functions.draws import NOISE_DRAWS, bigint_draw, hash_hex, pair_from_hex, uniform_from_pair
from giftrisk.operators.quantiles import exact_quantiles, first_k_masks


def irwin_hall_noise(key: Column, sd: float = C.NOISE_SD) -> tuple[dict[str, Column], Column]:
    hashes = {f"_hn_{salt}": hash_hex(key, salt) for salt in sorted({s for _, s, _ in NOISE_DRAWS})}
    total = None
    for _, salt, slot in NOISE_DRAWS:
        u = uniform_from_pair(pair_from_hex(F.col(f"_hn_{salt}"), slot // 2), slot)
        total = u if total is None else total + u
    return hashes, F.lit(sd) * (total - F.lit(6.0))


def add_noise(scored: DataFrame, stats: dict | None = None) -> DataFrame:
    """Score_Norm = (s - min) / (max - min + 1e-9); Score_Noisy = clip(norm + noise)."""
    s = F.col("Rule_Score")
    mm = scored.agg(F.min(s).alias("mn"), F.max(s).alias("mx"), F.count(s).alias("n")).first()
    mn, mx = float(mm["mn"]), float(mm["mx"])
    if stats is not None:
        stats.update(min=mn, max=mx, n=int(mm["n"]))
    return noise_columns(scored, mn, mx)


def label_draws(rows: DataFrame) -> DataFrame:
    """Adds ``_noise`` and ``_flip``, which depend on the key alone."""
    hashes, noise = irwin_hall_noise(F.col("Donation_ID"))
    flip = bigint_draw(F.col("Donation_ID"), "flip")
    return rows.withColumns(hashes).withColumns({"_noise": noise, "_flip": flip}).drop(*hashes)


def noise_columns(scored: DataFrame, mn: float, mx: float) -> DataFrame:
    """The columns of ``add_noise`` for a known score range; rows that hold their
    ``label_draws`` keep them, for the flips."""
    s = F.col("Rule_Score")
    df = scored if "_noise" in scored.columns else label_draws(scored).drop("_flip")
    df = df.withColumn("Score_Norm", (s - F.lit(mn)) / (F.lit(mx) - F.lit(mn) + F.lit(1e-9)))
    return df.withColumn("Score_Noisy", F.least(F.greatest(
        F.col("Score_Norm") + F.col("_noise"), F.lit(0.0)), F.lit(1.0))).drop("_noise")


def swap_label(labelled: DataFrame) -> DataFrame:
    """The bank's Is_Fraud gives way to Is_Anomalous, which takes its place as last column."""
    kept = [c for c in labelled.columns if c not in ("Is_Fraud", "Is_Anomalous")]
    return labelled.select(*kept, "Is_Anomalous")


def assign_labels(noisy: DataFrame, target_rate: float = C.TARGET_ANOMALY_RATE,
                  miss_rate: float = C.MISS_RATE, false_flag_rate: float = C.FALSE_FLAG_RATE,
                  stats: dict | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Label_Raw at the (1 - target) quantile of Score_Noisy, then the exact
    count flips; adds Label_Raw, Label_Flipped, Is_Anomalous. With ``onto``, which has
    the same rows with more columns, the passes read ``noisy`` (Donation_ID and
    Score_Noisy suffice) and the labels are added to ``onto``."""
    n = (stats or {}).get("n")  # Score_Noisy is never null: its count is the row count
    thr = exact_quantiles(noisy, {"t": (F.col("Score_Noisy"), 1 - target_rate)},
                          counts={"t": n} if n is not None else None)["t"]
    with_raw = lambda x: x.withColumn("Label_Raw", (F.col("Score_Noisy") >= F.lit(thr)).cast("int"))
    with_flip = lambda x: x if "_flip" in x.columns else x.withColumn("_flip", bigint_draw(F.col("Donation_ID"), "flip"))
    df = with_raw(noisy)
    counts = df.agg(F.count_if(F.col("Label_Raw") == 1).alias("pos"),
                    F.count_if(F.col("Label_Raw") == 0).alias("neg")).first()
    n_pos, n_neg = int(counts["pos"]), int(counts["neg"])
    k_miss, k_false = int(n_pos * miss_rate), int(n_neg * false_flag_rate)
    df = with_flip(df)
    m = first_k_masks(df, F.col("_flip"), F.col("Donation_ID"),
                      {"pos": (k_miss, F.col("Label_Raw") == 1), "neg": (k_false, F.col("Label_Raw") == 0)},
                      counts={"pos": n_pos, "neg": n_neg})
    df = df if onto is None else with_flip(with_raw(onto))
    df = df.withColumn("Label_Flipped", (m["pos"] | m["neg"]).cast("int")).drop("_flip")
    df = df.withColumn("Is_Anomalous", F.when(F.col("Label_Flipped") == 1, 1 - F.col("Label_Raw"))
                       .otherwise(F.col("Label_Raw")).cast("int"))
    if stats is not None:
        stats.update(threshold=thr, n_pos=n_pos, n_neg=n_neg, n_missed=k_miss, n_false_flag=k_false)
    return df


def label_scores(scored: DataFrame, target_rate: float = C.TARGET_ANOMALY_RATE,
                 miss_rate: float = C.MISS_RATE, false_flag_rate: float = C.FALSE_FLAG_RATE,
                 stats: dict | None = None) -> DataFrame:
    """Adds Score_Norm, Score_Noisy, Label_Raw, Label_Flipped and Is_Anomalous.
    ``stats`` (optional) receives the scalars used (min, max, threshold, counts)."""
    return assign_labels(add_noise(scored, stats), target_rate, miss_rate, false_flag_rate, stats)
