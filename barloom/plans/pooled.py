"""Pooled model dataset: eighteen features scored per date and the excess-return label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, clip, ratio
from ..operators import crosssection as xs
from ..operators import joins, labels

# The feature list of the pooled model.
FEATURES = ("ret_1", "ret_5", "ret_20", "vol_10", "vol_20", "rsi_14", "dist_sma20", "dist_sma50",
            "dist_sma200", "atr_ratio", "volume_ratio", "bench_ret_1", "bench_ret_20", "bench_vol",
            "rel_ret_20", "mom_12_1", "mom_6m", "liq")


def pooled_features(bars: DataFrame, bench: DataFrame, min_bars: int = 300, skip: int = 21,
                    back: int = 252, half: int = 126) -> DataFrame:
    df = ind.smoothed(bars, ["avg_gain", "avg_loss", "atr_ewm"])
    df = ind.returns(df, (1, 5, 20)).withColumns({
        "rsi_14": ind.rsi() / 100 - 0.5, "atr_ratio": ratio("atr_ewm", "close"),
        **{f"dist_sma{n}": ind.sma_distance(n) for n in (20, 50, 200)},
        "volume_ratio": clip(ind.volume_ratio(), upper=10.0),
        "mom_12_1": ind.skip_momentum("close", skip, back), "mom_6m": w.change("close", half),
        "liq": w.mean(c("volume") * c("close"), 20),
        "_bars": F.count(F.lit(1)).over(Window.partitionBy("sym"))})
    df = df.withColumns({"vol_10": w.std("ret_1", 10), "vol_20": w.std("ret_1", 20)})
    return joins.benchmark_features(df.where(c("_bars") >= min_bars), bench)


def pooled_dataset(bars: DataFrame, bench: DataFrame, horizon: int = 10,
                   bound: int | None = None, **options: int) -> DataFrame:
    """Rows with every feature known; z-scores per date, forward excess return and label.

    The newest rows have no forward return yet: their label is 0 and training drops them.  ``label_end``
    is the day on which a row's label is known.
    """
    df = bars.withColumns({"fwd_ret": w.forward("close", horizon),
                           "label_end": F.lead("date", horizon).over(Window.partitionBy("sym").orderBy("date"))})
    df = pooled_features(df, bench, **options).na.drop(subset=list(FEATURES))
    df = df.join(joins.benchmark_forward(bench, horizon), "date", "left")
    df = df.withColumn("fwd_excess", c("fwd_ret") - c("bench_fwd"))
    df = xs.zscore(df, FEATURES, bound=bound)
    return df.select("sym", "date", "close", *FEATURES, "fwd_ret", "fwd_excess",
                     labels.binary().alias("label"), "label_end")
