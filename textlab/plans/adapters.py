"""Fixture adapters: map the driver's tables onto the reference's inputs.

Every adapter is a pure column expression over a given table, so DuckDB can
repeat it (see ``textlab.plans.oracles``) and the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.hashing import hfrac

# The test lexicon (substring hits differ from word hits).
TEST_LEXICON = ["that", "with", "this", "from", "pour"]

# The five emoji appended by ``emoji_text`` (doc_id % 6 = 1..5).
TEST_EMOJI = ["\U0001F600", "❤", "\U0001F602", "\U0001F44D", "\U0001F525"]

# The five fixture models and how far each moves towards the truth.
MODEL_WEIGHTS = [("m1", 0.1), ("m2", 0.2), ("m3", 0.3), ("m4", 0.4), ("m5", 0.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source) -> F.Column:
    """Number in ``srcN`` mod 3 -> positive / neutral_a / neutral_b."""
    n = F.regexp_extract(source, r"(\d+)", 1).try_cast("int") % 3
    return (F.when(n == 0, "positive").when(n == 1, "neutral_a").otherwise("neutral_b"))


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))


def posts(spark, sf_dir) -> DataFrame:
    """Posts with injected null titles/bodies, blank bodies and null keys."""
    d = table(spark, sf_dir, "documents")
    nl = F.instr(F.col("text"), "\n")
    rest = F.when(nl == 0, F.lit("")).otherwise(F.expr("substr(text, instr(text, '\n') + 1)"))
    pid = F.col("doc_id")
    return d.select(
        pid.alias("post_id"),
        F.when(pid % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.substring_index("text", "\n", 1)).alias("title"),
        F.when(pid % 13 == 0, F.lit(None).cast("string"))
         .when(pid % 19 == 0, F.lit("  \n ")).otherwise(rest).alias("body"),
        F.when(pid % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.md5("text")).alias("retrieved_on"),
        domain_of(F.col("source")).alias("domain"),
        F.col("source"),
    )


def emoji_text(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 6
    e = F.lit("")
    for i, em in enumerate(TEST_EMOJI, start=1):
        e = F.when(m == i, F.lit(em)).otherwise(e)
    return d.select("doc_id", F.concat(F.col("text"), e).alias("text"))


def messages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    mid = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        mid.alias("message_id"), "conv_id", "turn", "role",
        F.when(mid % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("Message"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    """``documents ⋈ embeddings`` with domain and the two-class seed label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    e = table(spark, sf_dir, "embeddings")
    return (e.join(d, e.vec_id == d.doc_id, "inner")
            .select(F.col("vec_id").alias("id"), "text", "embedding",
                    domain_of(F.col("source")).alias("domain"),
                    (F.col("label") < 5).cast("int").alias("original_label")))


def two_class_vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label",
                    (F.col("label") < 5).cast("int").alias("original_label"))


def predictions(spark, sf_dir) -> DataFrame:
    """labels x models m1..m5 with a hash probability pulled towards the truth."""
    lab = table(spark, sf_dir, "labels")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w"))
                       for m, w in MODEL_WEIGHTS])
    x = lab.select("doc_id", F.col("quality").alias("label"), F.explode(models).alias("m"))
    prob = (1 - F.col("m.w")) * hfrac(F.col("m.model"), F.col("doc_id")) + F.col("m.w") * F.col("label")
    return x.select(F.col("m.model").alias("model"), "doc_id", "label",
                    prob.alias("prob"), (prob > 0.5).cast("int").alias("prediction"))


# Conversation turns follow the documents in the reply jobs' ids.
TURN_IDS = 10_000_000_000


def reply_texts(spark, sf_dir) -> DataFrame:
    """(doc_id, text): whole documents and whole conversation turns, what the reply jobs read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = table(spark, sf_dir, "conversations")
    return d.unionByName(c.select((F.lit(TURN_IDS) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def _is_positive() -> F.Column:
    from textlab.functions.lexicon import has_keyword
    return F.coalesce(has_keyword("text", TEST_LEXICON), F.lit(False))


def replies(spark, sf_dir) -> DataFrame:
    """Replies as the lexicon model gives them: the label is the lexicon rule on the message, and the shape
    (clean, digit in a sentence, no digit, empty, label line with spaces) follows its length."""
    d = reply_texts(spark, sf_dir)
    lab = _is_positive().cast("int").cast("string")
    w = F.coalesce("text", F.lit(""))
    k = F.length(w) % 5
    reply = (F.when(k == 0, F.concat(F.lit("Reads as: "), w, F.lit("\n"), lab))
             .when(k == 1, F.concat(F.lit("Label "), lab, F.lit(" because "), w))
             .when(k == 2, F.concat(F.lit("Unsure: "), w))
             .when(k == 3, F.lit(""))
             .otherwise(F.concat(w, F.lit("\n   "), lab, F.lit("  "))))
    return d.select("doc_id", "text", reply.alias("reply"))


def json_replies(spark, sf_dir) -> DataFrame:
    """JSON replies over the whole message, escaped by the JSON writer: plain, fenced, fenced after a
    newline, missing key, broken off."""
    d = table(spark, sf_dir, "documents")
    sent = F.when(_is_positive(), "positive").otherwise("negative")
    w = F.coalesce("text", F.lit(""))
    body = F.to_json(F.struct(w.alias("DM"), sent.alias("Sentiment")))
    short = F.to_json(F.struct(w.alias("DM")))
    k = F.length(w) % 5
    reply = (F.when(k == 0, body)
             .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("\n```json\n"), body, F.lit("\n```")))
             .when(k == 3, short)
             .otherwise(F.concat(F.substr(short, F.lit(1), F.length(short) - 1), F.lit(', "Sentiment": '))))
    return d.select(F.col("doc_id").alias("post_id"), reply.alias("reply"))


def trial_log(spark, sf_dir) -> DataFrame:
    """events as a trial log: trial = user, step = order in the trial
    (numbered without putting a whole user in one task)."""
    from textlab.operators.windows import group_row_number
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    x = group_row_number(ev, ["user_id"], ["ts", "event_id"], "step")
    return x.select(
        F.col("user_id").alias("trial"), F.col("step").cast("bigint").alias("step"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value") / 1000.0).alias("eval_f1"),
    )


def history(spark, sf_dir) -> DataFrame:
    """events as a training history: click/view = train loss, purchase/signup = eval loss."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"),
        (F.col("event_id") % 7).cast("double").alias("epoch"),
        F.when(t.isin("click", "view"), F.col("value")).alias("loss"),
        F.when(t.isin("purchase", "signup"), F.col("value")).alias("eval_loss"),
        F.when(t.isin("purchase", "signup"), F.col("value") / 1000.0).alias("eval_f1"),
    )
