"""Sweep bookkeeping: early stop (W2), best trial (G18), history summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _block_exits(patience: int, threshold: float, block: int):
    """mapInPandas step for ``early_stop`` over rows sorted by (t, b, i).

    For each (trial, block) group and each entry offset o < patience, follow
    the improvement chain inside the block (its own rows plus ``patience``
    look-ahead rows of the next block) and report where it leaves:
    ``exit_o`` = entry offset in the next block, or a terminal ``root`` (the
    last improvement; the stop is ``root + patience``). Vectorised over all
    groups of a batch: NumPy shifts for the look-ahead, NumPy pointer
    doubling for the chains. A group cut by a batch boundary is carried over.
    """
    import numpy as np
    import pandas as pd

    cols = ["t", "b", "o", "exit_o", "root", "root_f"]

    def process(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t"].to_numpy()
        b = pdf["b"].to_numpy(dtype=np.int64)
        idx = pdf["i"].to_numpy(dtype=np.int64)
        f = pdf["f"].to_numpy(dtype=np.float64)
        n = len(idx)
        start = b * block + 1
        end = start + block
        own = idx < end
        same = lambda d: (t[d:] == t[:n - d]) & (b[d:] == b[:n - d]) & (idx[d:] == idx[:n - d] + d)
        nxt = np.full(n, -1, dtype=np.int64)
        for d in range(patience, 0, -1):          # smallest hop wins
            if d >= n:
                continue
            ok = np.zeros(n, dtype=bool)
            ok[:n - d] = same(d) & (f[d:] > f[:n - d] + threshold)
            nxt[ok] = np.nonzero(ok)[0] + d
        ar = np.arange(n)
        # ptr: next improvement while it stays inside the block, else self
        ptr = np.where((nxt >= 0) & own[np.maximum(nxt, 0)], nxt, ar)
        for _ in range(max(1, int(block).bit_length())):
            ptr = ptr[ptr]
        entry = own & (idx - start < patience)
        last = ptr[entry]
        ex = nxt[last]
        out = pd.DataFrame({"t": t[entry], "b": b[entry], "o": (idx - start)[entry].astype(np.int32)})
        has_exit = ex >= 0
        out["exit_o"] = pd.array(np.where(has_exit, idx[np.maximum(ex, 0)] - end[entry], 0), dtype="Int64")
        out.loc[~has_exit, "exit_o"] = pd.NA
        out["root"] = pd.array(idx[last], dtype="Int64")
        out.loc[has_exit, "root"] = pd.NA
        out["root_f"] = np.where(has_exit, np.nan, f[last])
        return out[cols]

    def run(it):
        carry = None
        for pdf in it:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            lt, lb = pdf["t"].iloc[-1], pdf["b"].iloc[-1]
            tail = ((pdf["t"] == lt) & (pdf["b"] == lb)).to_numpy()
            carry = pdf[tail]
            if (~tail).any():
                yield process(pdf[~tail].reset_index(drop=True))
        if carry is not None and len(carry):
            yield process(carry.reset_index(drop=True))
    return run


def early_stop(df: DataFrame, trial_col: str = "trial", step_col: str = "step",
               metric_col: str = "eval_f1", patience: int = 3, threshold: float = 0.0,
               block: int = 4096, n_parts: int | None = None) -> DataFrame:
    """Per trial, the step at which early stopping fires (null if never).

    Fold semantics: a value improves only if ``f1 > best + threshold`` (then
    bad = 0), else bad += 1; stop at the first step where ``bad >= patience``;
    null metrics change nothing. A running max is not equivalent when
    threshold > 0.

    Exact and distributed, with no trial held in one task. Every improvement
    resets the state to (its own value, 0), so the improvements form a chain
    whose hops are at most ``patience`` rows long; a row with no improvement
    in the next ``patience`` rows ends the chain and the trial stops
    ``patience`` rows later. Non-null rows get a dense index per trial and are
    cut into blocks of ``block`` rows; a chain can enter a block only at one
    of its first ``patience`` rows, so one grouped pandas step per
    (trial, block) maps each entry to its exit (or end). Blocks are then
    chained by pointer jumping over that small table (log2(blocks per trial)
    rounds; none when a trial fits one block).
    """
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    from textlab.operators.windows import group_row_number
    from textlab.session import stage

    block = max(block, patience)  # a hop (<= patience rows) then never skips a block
    x = df.where(F.col(metric_col).isNotNull()).select(
        F.col(trial_col).alias("t"), F.col(step_col).alias("s"), F.col(metric_col).cast("double").alias("f"))
    x = group_row_number(x, ["t"], ["s"], "i", n_parts)  # slices are staged inside
    b = F.floor((F.col("i") - 1) / block).cast("long")
    own = x.select("t", "i", "f", b.alias("b"))
    # the first `patience` rows of each block are also given to the previous block
    ahead = (x.where((F.col("i") - 1) % block < patience).where(F.col("i") > block)
             .select("t", "i", "f", (b - 1).alias("b")))
    tt = x.schema["t"].dataType
    schema = StructType([StructField("t", tt), StructField("b", LongType()), StructField("o", IntegerType()),
                         StructField("exit_o", LongType()), StructField("root", LongType()),
                         StructField("root_f", DoubleType())])
    grouped = own.unionByName(ahead).repartition("t", "b").sortWithinPartitions("t", "b", "i")
    exits = grouped.mapInPandas(_block_exits(patience, threshold, block), schema)
    sizes = x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("best_f1"))
    longest = int(sizes.agg(F.max("n")).first()[0] or 0)
    blocks = max(1, -(-longest // block))
    if blocks > 1:
        exits = stage(exits, "early-stop-blocks")
    # pointer jumping over (t, b, o): "entering block b at offset o" leads to a
    # terminal root, or to entering block tb at offset exit_o; each round
    # follows the pointer of the entry it points to
    cur = exits.select("t", "b", "o", (F.col("b") + 1).alias("tb"), "exit_o", "root", "root_f")
    for _ in range(max(0, (blocks - 1).bit_length())):
        nxt = cur.select("t", F.col("b").alias("tb"), F.col("o").alias("exit_o"),
                         F.col("tb").alias("n_tb"), F.col("exit_o").alias("n_exit"),
                         F.col("root").alias("n_root"), F.col("root_f").alias("n_root_f"))
        j = cur.join(nxt, ["t", "tb", "exit_o"], "left")
        done = F.col("exit_o").isNull()
        cur = stage(j.select("t", "b", "o",
                             F.when(done, F.col("tb")).otherwise(F.col("n_tb")).alias("tb"),
                             F.when(done, F.col("exit_o")).otherwise(F.col("n_exit")).alias("exit_o"),
                             F.when(done, F.col("root")).otherwise(F.col("n_root")).alias("root"),
                             F.when(done, F.col("root_f")).otherwise(F.col("n_root_f")).alias("root_f")),
                    "early-stop-chain")
    res = cur.where((F.col("b") == 0) & (F.col("o") == 0)).select("t", "root", "root_f")
    st = x.select("t", F.col("i").alias("stop_i"), F.col("s").alias("stop_step"))
    out = (res.withColumn("stop_i", F.col("root") + F.lit(patience))
           .join(st, ["t", "stop_i"], "left").join(sizes, "t"))
    return out.select(F.col("t").alias(trial_col), F.col("stop_step").cast("bigint").alias("stop_step"),
                      F.round("root_f", 6).alias("best_at_stop"), F.round("best_f1", 6).alias("best_f1"))


def best_trial(df: DataFrame, trial_col: str = "trial", metric_col: str = "eval_f1") -> DataFrame:
    """The trial with the highest metric; strict improvement from 0, so
    the earliest trial wins ties and a table without a positive metric gives
    no row."""
    best = (df.where(F.col(metric_col) > 0)
            .agg(F.max_by(F.struct(F.col(trial_col).alias("trial"),
                                   F.col(metric_col).alias("f1")),
                          F.struct(F.col(metric_col), -F.col(trial_col))).alias("_b")))
    return best.where(F.col("_b").isNotNull()).select(
        F.col("_b.trial").alias("best_trial"), F.round("_b.f1", 6).alias("best_f1"))


def history_summary(df: DataFrame, run_col: str = "run", step_col: str = "step") -> DataFrame:
    """From a ragged log (train rows have ``loss`` and no ``eval_loss``;
    eval rows have ``eval_loss``): last train loss and step, number of train
    rows (named ``total_steps``), last eval loss / F1 / epoch."""
    train = F.col("loss").isNotNull() & F.col("eval_loss").isNull()
    ev = F.col("eval_loss").isNotNull()
    s = F.col(step_col)
    return df.groupBy(run_col).agg(
        F.max_by(F.when(train, F.col("loss")), F.when(train, s)).alias("last_train_loss"),
        F.max(F.when(train, s)).alias("last_train_step"),
        F.count_if(train).alias("total_steps"),
        F.max_by(F.when(ev, F.col("eval_loss")), F.when(ev, s)).alias("last_eval_loss"),
        F.max_by(F.when(ev, F.col("eval_f1")), F.when(ev, s)).alias("last_eval_f1"),
        F.max_by(F.when(ev, F.col("epoch")), F.when(ev, s)).alias("last_eval_epoch"),
    )
