"""The stored shingle index and the stream on it: old and new together equal the full run."""

import re

import pytest
from pyspark.sql import functions as F

from codesim.operators import index as I
from codesim.params import Params
from codesim.plans.analyze import Analysis
from codesim.streaming import intake

BODY = "\n".join(f"value_{i} = compute(item_{i}, {i})" for i in range(14)) + "\n"


def body(k):
    return BODY.replace("item", f"thing{k}") if k else BODY


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for s in range(9):
        rows += [(s, f"s{s}", f"s{s}/a.py", body(0)), (s, f"s{s}", f"s{s}/b.py", body(s % 3) + f"extra{s} = {s}\n"),
                 (s, f"s{s}", f"s{s}/c.py", body(100 + s)), (s, f"s{s}", f"s{s}/empty.py", "#\n" * 12)]
    return spark.createDataFrame(rows, "submission_id long, submission string, raw_path string, content string")


def shown(df):
    return sorted(tuple(r) for r in df.select(*I.COUNTS).collect())


@pytest.mark.parametrize("limit", [2, 2000])
def test_old_and_new_equal_the_full_run(spark, files, tmp_path, limit):
    params = Params(block_rows=limit)
    parts = [Analysis(files.where(c), None, params) for c in ("submission_id IN (0, 2, 5)", "submission_id IN (1, 7, 8)", "submission_id IN (3, 4, 6)")]
    path = str(tmp_path / "index")
    at = I.build(spark, path, parts[0].sets, parts[0].reps, buckets=4, limit=limit, label="one")
    got = shown(parts[0].counts)
    got += shown(at.counts_added(parts[1].sets, parts[1].reps))
    at.add(parts[1].sets, parts[1].reps, "two")
    # an addition that stops before its line in the manifest is never read
    lost = parts[2].sets.withColumn("addition", F.lit("lost")).select(*I.CLS, "submission_id", "path", "ext", "n_shingles", F.lit(0).alias("t"), "addition")
    lost.repartition(4, *I.TABLES["members"]).write.mode("append").format("parquet").bucketBy(4, *I.TABLES["members"]).sortBy(*I.TABLES["members"]).option("path", f"{path}/members").saveAsTable(at._name("members"))
    for table in I.TABLES:  # as in another session
        spark.sql(f"DROP TABLE {at._name(table)}")
    again = I.open_index(spark, path)
    assert again == at and again.has("two") and not again.has("three")
    got += shown(again.counts_added(parts[2].sets, parts[2].reps))
    want = shown(Analysis(files, None, params).counts)
    assert len(want) > 60 and sorted(got) == want
    with pytest.raises(ValueError):
        I.build(spark, path, parts[0].sets, parts[0].reps)


def test_the_old_side_is_not_shuffled(spark, files, tmp_path, capsys):
    old, new = (Analysis(files.where(c), None, Params()) for c in ("submission_id < 6", "submission_id >= 6"))
    at = I.build(spark, str(tmp_path / "index"), old.sets, old.reps, buckets=8)
    at.counts_with_old(new.sets, new.reps).explain()
    plan = capsys.readouterr().out
    lines = plan.splitlines()
    scans = [i for i, x in enumerate(lines) if "Bucketed: true" in x]
    assert len(scans) == 2
    for i in scans:  # from the scan up to its join: filters, projections and sorts, no exchange
        above = []
        depth = lines[i].index("FileScan") if "FileScan" in lines[i] else 0
        for x in reversed(lines[:i]):
            at_ = re.search(r"[A-Za-z]", x)
            if at_ and at_.start() < depth:
                depth = at_.start()
                above.append(x)
                if "Join" in x:
                    break
        assert above and "Join" in above[-1] and not any("Exchange" in x for x in above), above


def test_no_pair_is_shuffled(spark, files, tmp_path, capsys):
    """Pairs of new and old files, and of new ones, come straight from tiles: above them there is no exchange."""
    old, new = (Analysis(files.where(c), None, Params()) for c in ("submission_id < 6", "submission_id >= 6"))
    at = I.build(spark, str(tmp_path / "index"), old.sets, old.reps, buckets=8)
    written = []

    def keep(df, name, rows_each=0):
        written.append(name)
        return new._keep(df, name, rows_each)

    added = at.counts_added(new.sets, new.reps, keep)
    assert sorted(written) == ["shared_sets", "tile_blocks", "tile_blocks"]
    at.counts_with_old(new.sets, new.reps, keep).explain()
    above = capsys.readouterr().out.split("CartesianProduct")
    assert len(above) == 2 and "Exchange" not in above[0] and "Aggregate" not in above[0]
    want = shown(Analysis(files, None, Params()).counts)
    assert sorted(shown(added) + shown(old.counts)) == want
    new.cleanup()


def test_stream_replays_give_the_full_run(spark, files, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "out")
    for k in range(3):
        files.where(F.col("submission_id") % 3 == k).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    params = Params()
    intake.intake(stream, folder, None, params, buckets=4).trigger(availableNow=True).start().awaitTermination()
    want = shown(Analysis(files, None, params).counts)
    assert shown(intake.counts(spark, folder)) == want
    # the last batch once more, as after a failure
    again = files.where("submission_id % 3 = 2")
    intake.take_in(again, 2, folder, None, params, 4)
    assert shown(intake.counts(spark, folder)) == want


def test_a_failed_batch_is_taken_in_once(spark, files, tmp_path, monkeypatch):
    folder, params = str(tmp_path / "out"), Params()
    first, second = (files.where(c) for c in ("submission_id < 5", "submission_id >= 5"))
    real = I.Index.add

    def fails(*_):
        raise RuntimeError("lost")

    for number, batch in enumerate((first, second)):
        monkeypatch.setattr(I.Index, "add", fails)
        with pytest.raises(RuntimeError):
            intake.take_in(batch, number, folder, None, params, 4)
        monkeypatch.setattr(I.Index, "add", real)
        intake.take_in(batch, number, folder, None, params, 4)
        intake.take_in(batch, number, folder, None, params, 4)
    assert shown(intake.counts(spark, folder)) == shown(Analysis(files, None, params).counts)
