"""Sources, sinks and incremental jobs on temp folders (no servers)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from textlab.sources import files as S
from textlab.streaming import jobs as R


def test_read_posts_csv_nulls(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "posts.csv")
    with open(p, "w") as f:
        f.write('title,selftext_or_url_reference,retrieved_on,extra\n'
                ',NA,1,x\n'
                'NaN,null,2,x\n'
                '"multi\nline",body,3,x\n'
                '"a, b","say ""hi""",4,x\n')
    rows = S.read_posts(spark, p).orderBy("retrieved_on").collect()
    assert [r["title"] for r in rows] == [None, None, "multi\nline", "a, b"]
    assert [r["selftext_or_url_reference"] for r in rows] == [None, None, "body", 'say "hi"']


def test_tolerant_union_and_read_columns(spark, tmpdir_fresh):
    good1 = os.path.join(tmpdir_fresh, "a.csv")
    good2 = os.path.join(tmpdir_fresh, "b.csv")
    bad = os.path.join(tmpdir_fresh, "c.csv")
    for path, header in ((good1, "DM,label"), (good2, "DM,label"), (bad, "other,label")):
        with open(path, "w") as f:
            f.write(header + "\nhello,1\nworld,0\n")
    df, report = S.tolerant_union(spark, [good1, good2, bad, os.path.join(tmpdir_fresh, "missing.csv")],
                                  ["DM", "label"])
    assert df.count() == 4
    assert df.select("source_file").distinct().count() == 2
    assert sorted(r["reason"] for r in report.collect()) == ["missing DM", "unreadable"]
    with pytest.raises(ValueError):
        S.tolerant_union(spark, [bad], ["DM"])
    assert S.read_columns(spark, good1, ["DM"]).columns == ["DM"]
    with pytest.raises(ValueError):
        S.read_columns(spark, bad, ["DM"])


def test_read_messages_dir_skips_bad_files(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "msgs")
    spark.createDataFrame([("a",), (None,)], "Message string").coalesce(1).write.parquet(d + "/one")
    spark.createDataFrame([("b",)], "Message string").coalesce(1).write.parquet(d + "/two")
    spark.createDataFrame([("c",)], "Other string").coalesce(1).write.parquet(d + "/three")
    with open(os.path.join(d, "corrupt.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    df, report = S.read_messages_dir(spark, d)
    assert sorted(r["sentence"] for r in df.collect()) == ["a", "b"]
    reasons = sorted(r["reason"] for r in report.collect())
    assert reasons == ["no column Message", "unreadable"]


def test_writers_and_stage(spark, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "labelled")
    S.write_labelled(spark.createDataFrame([("s1", 1)], "source string, v int"), out)
    S.write_labelled(spark.createDataFrame([("s2", 2)], "source string, v int"), out)
    S.write_labelled(spark.createDataFrame([("s1", 3)], "source string, v int"), out)
    assert sorted((r["source"], r["v"]) for r in spark.read.parquet(out).collect()) == [("s1", 3), ("s2", 2)]
    pred = spark.createDataFrame([("m1", 1, 1, 1), ("m2", 2, 0, 1)], "model string, id int, label int, prediction int")
    S.write_predictions(pred, os.path.join(tmpdir_fresh, "pred"))
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "pred")).where("correct").count() == 1
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert S.materialize_stage(spark, tmpdir_fresh, "st", {"a": 1}, build).count() == 5
    assert len(calls) == 1
    log = os.path.join(tmpdir_fresh, "trials")
    S.append_trial_log(spark.createDataFrame([(1, 0.5)], "trial int, f1 double"), log)
    S.append_trial_log(spark.createDataFrame([(2, 0.6)], "trial int, f1 double"), log)
    assert spark.read.parquet(log).count() == 2


def _write_msgs(spark, path, start, n):
    (spark.range(start, start + n).select(F.col("id").alias("message_id"),
                                          F.concat(F.lit("msg "), F.col("id").cast("string")).alias("Message"))
     .coalesce(1).write.mode("overwrite").parquet(path))


def test_score_new_files_rerun_adds_nothing(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    out = os.path.join(tmpdir_fresh, "out")
    ck = os.path.join(tmpdir_fresh, "ck")
    _write_msgs(spark, src + "/f1", 0, 10)
    _write_msgs(spark, src + "/f2", 10, 5)
    schema = "message_id long, Message string"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)

    def score(df):
        return df.withColumn("prediction", (F.length("Message") % 2).cast("int"))

    R.score_new_files(spark, src + "/*", st, out, ck, score)
    assert spark.read.parquet(out).count() == 15
    R.score_new_files(spark, src + "/*", st, out, ck, score)
    assert spark.read.parquet(out).count() == 15
    _write_msgs(spark, src + "/f3", 100, 3)
    R.score_new_files(spark, src + "/*", st, out, ck, score)
    assert spark.read.parquet(out).select("message_id").distinct().count() == 18


def test_resume_generation_twice_equals_once(spark, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "gen")
    todo = spark.range(60).select(F.col("id").alias("post_id"))
    gen = lambda df: df.withColumn("DM", F.concat(F.lit("dm "), F.col("post_id").cast("string")))
    assert R.resume_generation(todo, out, "post_id", gen, slice_rows=25) == 3
    assert R.resume_generation(todo, out, "post_id", gen, slice_rows=25) == 0
    got = spark.read.parquet(out)
    assert got.count() == 60 and got.select("post_id").distinct().count() == 60


def test_streaming_progress_and_dedup(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "lab")
    for i in range(3):
        (spark.range(i * 10, i * 10 + 10)
         .select(F.col("id").alias("message_id"),
                 F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("int")).alias("label"))
         .coalesce(1).write.parquet(f"{src}/b{i}"))
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string("message_id long, label int")
    out = os.path.join(tmpdir_fresh, "prog")
    R.streaming_progress(spark, src + "/*", st, out, os.path.join(tmpdir_fresh, "ck2"))
    tot = R.running_totals(spark, out).orderBy("batch_id").collect()
    assert tot[-1]["cum_total"] == 30 and tot[-1]["cum_nulls"] == 10


@pytest.mark.parametrize("newest_first", [False, True])
def test_streaming_dedup_does_not_depend_on_batches(spark, tmpdir_fresh, newest_first):
    rows = [(k, t, f"v{t}") for t, k in enumerate([1, 2, 1, 3, None, 2, 4, 1, None, 3, 5, 5])]
    src = os.path.join(tmpdir_fresh, "ev")
    parts = [rows[i:i + 2] for i in range(0, 12, 2)]
    for i, part in enumerate(parts[::-1] if newest_first else parts):
        spark.createDataFrame(part, "key long, at long, v string").coalesce(1).write.parquet(f"{src}/f{i}")
    stream = R.table_stream(spark, src + "/*", max_files=1)
    out = R.streaming_dedup(stream, "key", "at", tmpdir_fresh + "/out", tmpdir_fresh + "/ck")
    assert sorted(((r.key or 0), r.at, r.v) for r in out.collect()) == [
        (0, 4, "v4"), (1, 0, "v0"), (2, 1, "v1"), (3, 3, "v3"), (4, 6, "v6"), (5, 10, "v10")]


@pytest.mark.parametrize("newest_first", [False, True])
def test_streaming_dedup_ties_and_nulls_in_later_batches(spark, tmpdir_fresh, newest_first):
    parts = [[(1, 5, "b"), (2, 5, "x"), (3, None, "d")], [(1, 5, "a"), (2, None, "y"), (3, None, "c")]]
    src = os.path.join(tmpdir_fresh, "ev")
    for i, part in enumerate(parts[::-1] if newest_first else parts):
        spark.createDataFrame(part, "key long, at long, v string").coalesce(1).write.parquet(f"{src}/f{i}")
    stream = R.table_stream(spark, src + "/*", max_files=1)
    out = R.streaming_dedup(stream, "key", "at", tmpdir_fresh + "/out", tmpdir_fresh + "/ck")
    assert sorted((r.key, r.at, r.v) for r in out.collect()) == [(1, 5, "a"), (2, None, "y"), (3, None, "c")]


def test_score_new_files_reports_what_it_skips(spark, tmpdir_fresh):
    src, out = os.path.join(tmpdir_fresh, "src"), os.path.join(tmpdir_fresh, "out")
    _write_msgs(spark, src + "/f1", 0, 10)
    spark.createDataFrame([(1,)], "other long").coalesce(1).write.parquet(src + "/f2")
    _damaged(spark, src + "/f3")
    st = spark.read.parquet(src + "/f1").schema
    R.score_new_files(spark, src + "/*", st, out, tmpdir_fresh + "/ck", lambda df: df.withColumn("p", F.lit(1)),
                      column="Message")
    assert spark.read.parquet(out).count() == 10
    assert sorted(r.reason for r in spark.read.parquet(out + "-report").collect()) == ["damaged", "no column Message"]


def _damaged(spark, path):
    """A parquet file whose footer is good and whose body is not."""
    (spark.range(200_000).select(F.col("id").alias("message_id"), F.sha2(F.col("id").cast("string"), 256).alias("Message"))
     .coalesce(1).write.parquet(path))
    f = next(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".parquet"))
    crc = os.path.join(path, f".{os.path.basename(f)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with open(f, "r+b") as h:
        size = os.path.getsize(f)
        h.seek(size // 4)
        h.write(os.urandom(size // 2))


def test_read_messages_dir_reports_damaged_bodies(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "msgs")
    spark.createDataFrame([("a",), ("b",)], "Message string").coalesce(1).write.parquet(d + "/one")
    _damaged(spark, d + "/two")
    df, report = S.read_messages_dir(spark, d)
    assert sorted(r["sentence"] for r in df.collect()) == ["a", "b"]
    assert [r.reason for r in report.collect()] == ["damaged"]


def test_damage_in_the_second_column_is_reported(spark, tmpdir_fresh):
    """_damaged leaves message_id, the first column, whole."""
    src, out = tmpdir_fresh + "/src", tmpdir_fresh + "/out"
    good = spark.createDataFrame([(1, "a"), (2, "b")], "message_id long, Message string")
    good.coalesce(1).write.parquet(src + "/one")
    _damaged(spark, src + "/two")
    assert spark.read.parquet(src + "/two").agg(F.max(F.xxhash64("message_id"))).first()[0] is not None
    df, report = S.tolerant_union(spark, S._list_files(spark, src, ".parquet"), ["message_id", "Message"], "parquet")
    assert sorted(r["Message"] for r in df.collect()) == ["a", "b"]
    assert [r["reason"] for r in report.collect()] == ["damaged"]
    R.score_new_files(spark, src + "/*", good.schema, out, tmpdir_fresh + "/ck", lambda df: df.drop("source_file"))
    assert sorted(r["Message"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    assert [r["reason"] for r in spark.read.parquet(out + "-report").collect()] == ["damaged"]


def test_read_posts_folder_with_mixed_headers(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "posts")
    os.makedirs(d)
    for name, text in (("a.csv", 'title,selftext_or_url_reference,retrieved_on\nA,b,1\n'),
                       ("b.csv", 'retrieved_on,extra,title,selftext_or_url_reference\n2,x,B,"c\nd"\n')):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    rows = S.read_posts(spark, d).orderBy("retrieved_on").collect()
    assert [tuple(r) for r in rows] == [("A", "b", "1"), ("B", "c\nd", "2")]


def test_stage_follows_its_inputs(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "in")
    spark.range(3).write.parquet(src)
    build = lambda: spark.read.parquet(src)
    get = lambda: S.materialize_stage(spark, tmpdir_fresh, "s", {}, build, [src]).count()
    assert get() == 3
    spark.range(2).write.mode("append").parquet(src)
    assert get() == 5


def test_cluster_needs_a_shared_folder(monkeypatch):
    from textlab import session

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": staticmethod(lambda: Conf())})()
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())


def _jobs(spark, group, work):
    """Spark jobs that ``work`` runs."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_files(spark, tmpdir_fresh):
    counts = []
    for n in (2, 12):
        root = f"{tmpdir_fresh}/n{n}"
        for i in range(n):
            _write_msgs(spark, f"{root}/f{i}", 10 * i, 3)
        paths = S._list_files(spark, root, ".parquet")
        counts.append([
            _jobs(spark, f"s2-{n}", lambda: S.read_messages_dir(spark, root)),
            _jobs(spark, f"s4-{n}", lambda: S.tolerant_union(spark, paths, ["message_id", "Message"], "parquet")),
            _jobs(spark, f"s5-{n}", lambda: S.require_column(spark, paths, "Message"))])
    assert counts[0] == counts[1] and all(0 < c < 12 for c in counts[0])


def test_footers_by_both_ways(spark, tmpdir_fresh):
    """In a job by Python's readers, and on the driver by Hadoop's: the same names, rows and gaps."""
    spark.createDataFrame([(1, "a"), (2, None)], "a long, `b c` string").coalesce(1).write.parquet(tmpdir_fresh + "/x y")
    spark.range(0).coalesce(1).write.parquet(tmpdir_fresh + "/none")
    for name, data in (("short.parquet", b"PAR1"), ("junk.parquet", b"PAR1" + b"x" * 40)):
        with open(os.path.join(tmpdir_fresh, name), "wb") as f:
            f.write(data)
    paths = S._list_files(spark, tmpdir_fresh, ".parquet") + [tmpdir_fresh + "/not-there.parquet"]
    got = S.footers(spark, paths)
    assert sorted(got.values(), key=str) == sorted([(["a", "b c"], 2), (["id"], 0), None, None, None], key=str)
    by_driver = {p: (t := S._footer_bytes(spark, p)) and S._footer(t) for p in paths}
    assert by_driver == got
    whole, bad = S.read_whole(spark, {p: f[1] for p, f in got.items() if f and "a" in f[0]}, ["a"])
    assert bad == [] and sorted(r.a for r in whole.collect()) == [1, 2]


@pytest.mark.parametrize("max_files", [1, 2, 10])
def test_progress_does_not_depend_on_batches(spark, tmpdir_fresh, max_files):
    rows = [(i * 7 % 40, [None, 0, 1, 2][i % 4]) for i in range(40)]
    src, out = tmpdir_fresh + "/src", tmpdir_fresh + "/out"
    for i in range(5):
        spark.createDataFrame(rows[8 * i:8 * i + 8], "message_id long, label int").coalesce(1).write.parquet(f"{src}/f{i}")
    schema = spark.read.parquet(src + "/f0").schema
    assert R.first_examples(spark, out) is None
    R.streaming_progress(spark, src + "/*", schema, out, tmpdir_fresh + "/ck", order_by=("message_id",), max_files=max_files)
    want = [(lab, k + 1, i) for lab in (0, 1, 2) for k, i in enumerate(sorted(i for i, x in rows if x == lab)[:3])]
    assert sorted((r.label, r.pick, r.message_id) for r in R.first_examples(spark, out).collect()) == want
    last = R.running_totals(spark, out).orderBy(F.desc("batch_id")).first()
    assert (last.cum_total, last.cum_nulls) == (40, 10)
    R.streaming_progress(spark, src + "/*", schema, out, tmpdir_fresh + "/ck", order_by=("message_id",))
    assert R.first_examples(spark, out).count() == 9


def test_dedup_state_is_keyed_and_resumes(spark, tmpdir_fresh):
    """A later run takes up the state of the earlier one, and a batch writes rows of its own keys only."""
    src, out, ck = (f"{tmpdir_fresh}/{x}" for x in ("ev", "out", "ck"))

    def arrive(name, rows):
        spark.createDataFrame(rows, "key long, at long, v string").coalesce(1).write.parquet(f"{src}/{name}")
        stream = R.table_stream(spark, src + "/*", max_files=1)
        return sorted((r.key, r.at, r.v) for r in R.streaming_dedup(stream, "key", "at", out, ck).collect())

    assert arrive("f0", [(k, 5, "a") for k in range(50)]) == [(k, 5, "a") for k in range(50)]
    assert arrive("f1", [(3, 9, "late"), (4, 1, "early"), (50, 2, "new")])[3:5] == [(3, 5, "a"), (4, 1, "early")]
    second = spark.read.parquet(out).where("batch_id = 1")
    assert sorted((r.key, r.at, r.v) for r in second.collect()) == [(3, 5, "a"), (4, 1, "early"), (50, 2, "new")]
    state = spark.read.format("statestore").load(ck)
    assert state.count() == 51
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_two_writers_of_a_stage_do_not_clash(spark, tmpdir_fresh):
    """The second writer starts before the first has published; one folder stays, and both read it."""
    root, calls = tmpdir_fresh + "/stages", []
    late = lambda: calls.append("late") or spark.range(7)

    def early():
        calls.append("early")
        assert S.materialize_stage(spark, root, "s", {"v": 1}, late).count() == 7  # publishes first
        return spark.range(5)

    assert S.materialize_stage(spark, root, "s", {"v": 1}, early).count() == 7
    assert S.materialize_stage(spark, root, "s", {"v": 1}, early).count() == 7
    assert calls == ["early", "late"]
    assert len([n for n in os.listdir(root) if not n.startswith(".")]) == 2  # the manifest and one folder


def test_stages_expire_and_leave_nothing_behind(spark, tmpdir_fresh):
    root = tmpdir_fresh + "/stages"
    get = lambda n, **more: S.materialize_stage(spark, root, "s", {"v": 1}, lambda: spark.range(n), **more)
    old = get(3, owner="me", expires_after=-1)
    assert get(4, owner="me").count() == 4 and old.count() == 3  # the expired one is still there for its readers
    S.materialize_stage(spark, root, "other", {}, lambda: spark.range(2), owner="you")
    assert len(S.drop_stages(spark, root)) == 1
    assert get(9).count() == 4
    assert len(S.drop_stages(spark, root, owner="me")) == 1 and len(S.drop_stages(spark, root, owner="you")) == 1
    assert [n for n in os.listdir(root) if not n.endswith(".crc")] == []


def test_scratch_clears_stages_and_tables(spark):
    from textlab import session
    where = os.path.join(session.ensure_checkpoint_dir(spark).removeprefix("file:"), "stages")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    with session.scratch(spark):
        with session.scratch(spark):
            inner = session.stage(spark.range(3), "inner")
            assert inner.count() == 3
        outer = session.stage(spark.range(4), "outer")
        spark.range(2).write.saveAsTable("scratch_table")
        session.made("table", "scratch_table")
        assert outer.count() == 4
    assert (set(os.listdir(where)) if os.path.isdir(where) else set()) == before
    assert not spark.catalog.tableExists("scratch_table")
    assert session.stage(spark.range(5), "kept").count() == 5
